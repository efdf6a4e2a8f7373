"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, conversation_trie, decontamination, line_spread, near_duplicates, ngram_join, periodic_runs, pitman_yor, quality, recompression, run_length_index, surrogates, tool_calls

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_length_index.digests(run_length_index.remove_repeats(_table(spark, sf_dir, "documents")))


def op2_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_spread.remove_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode(docs, public_tokenizers.path(TOKENIZER)))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get("spark.tidemark.surrogates.key", "key of the registered query"), count=True)
    return out.select("doc_id", "n_replaced", "text")


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.digests(recompression.remove_repeats(_table(spark, sf_dir, "documents")))


def op6_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "quality.*")


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def tool_schemas(spark: SparkSession) -> DataFrame:
    """The tools of tool_calls.as_tool_messages()."""
    common = [("query", "string", True), ("filter", "object", True), ("filter.lang", "string", True), ("filter.limit", "integer", True), ("filter.of", "array", False)]
    rows = [(n, *x) for n in ("search", "translate", "summarise") for x in common] + [(n, "after", "string", False) for n in ("search", "summarise")]
    return spark.createDataFrame([*rows, ("merge", "sources", "array", True), ("merge", "weight", "integer", True)], "name string, argument string, type string, required boolean")


def op8_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = tool_calls.as_tool_messages(_table(spark, sf_dir, "conversations"))
    out = tool_calls.link(messages, tool_schemas(spark))
    return out.select("conv_id", "call_id", "turn", "name", "level", "place", "result_turn", F.sha2("content", 256).alias("content_sha256"), "linked", "valid", "problems", F.sha2("json", 256).alias("json_sha256"))


def op9_multi_index_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classify(_table(spark, sf_dir, "documents"), width=2)


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(_table(spark, sf_dir, "documents"), context_bytes=None)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_planted_runs(_table(spark, sf_dir, "documents"))))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.forked(conversation_trie.placed(_table(spark, sf_dir, "conversations")))
    return conversation_trie.trie_of(turns).drop("node", "parent")


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_run_length_index, op2_line_spread, op3_bpe_codec, op4_surrogates, op5_recompression, op6_quality_divergence, op7_spaced_seeds, op8_tool_links, op9_multi_index_minhash, op10_pitman_yor, op11_periodic_runs, op12_conversation_trie, op13_ngram_join)}


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) AS z FROM documents
), l AS (
  SELECT doc_id, source, z[2] AS place, z[1] AS line, trim(z[1], concat(' ', chr(9), chr(13), chr(11), chr(12))) AS bare FROM lines
), b AS (
  SELECT bare, min(struct_pack(d := doc_id, p := place)) AS first FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT coalesce(source, '')) >= 3
), m AS (
  SELECT l.*, b.bare IS NOT NULL AND NOT (b.first.d = doc_id AND b.first.p = place) AS gone FROM l LEFT JOIN b ON l.bare = b.bare
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


OP8_SQL = r"""
WITH u AS (
  SELECT conv_id, turn, coalesce(min(text), '') AS text FROM conversations WHERE role = 'user' GROUP BY conv_id, turn
), r AS (
  SELECT conv_id, turn, min(text) AS content FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn
), k AS (
  SELECT *, length(text) AS n, concat('c', conv_id, '-', turn) AS id, concat('c', conv_id, '-', turn - 2) AS before,
    conv_id % 11 <> 0 AND count(*) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) = turn // 2 + 1 AS ordered FROM u
), c AS (
  SELECT conv_id, turn, concat(id, 'a') AS call_id, ['search', 'translate', 'summarise'][n % 3 + 1] AS name, CASE WHEN ordered THEN turn // 2 * 2 END AS level,
    concat_ws(',', CASE WHEN conv_id % 5 = 0 THEN 'type:filter.limit' END, CASE WHEN turn >= 2 AND n % 3 = 1 THEN 'unknown:after' END) AS problems,
    concat('{', CASE WHEN turn >= 2 THEN concat('"after":{"$ref":"', before, 'b"},') ELSE '' END, '"filter":{"lang":"en","limit":', CASE WHEN conv_id % 5 = 0 THEN concat('"', n, '"') ELSE concat('', n) END,
      CASE WHEN conv_id % 11 = 0 THEN concat(',"of":[{"$ref":"', id, 'b"}]') ELSE '' END, '},"query":', to_json(text), '}') AS arguments FROM k
  UNION ALL
  SELECT conv_id, turn, concat(id, 'b'), 'merge', CASE WHEN ordered THEN turn // 2 * 2 + 1 END, CASE WHEN n % 2 = 1 THEN 'type:weight' ELSE '' END,
    concat('{"sources":[{"$ref":"', id, 'a"}],"weight":', n // 2, CASE WHEN n % 2 = 1 THEN '.5' ELSE '' END, '}') FROM k
)
SELECT c.conv_id, call_id, c.turn, name, level, CASE WHEN level IS NOT NULL THEN row_number() OVER (PARTITION BY c.conv_id ORDER BY level NULLS LAST, c.turn, call_id) END AS place,
  r.turn AS result_turn, sha256(r.content) AS content_sha256, r.turn IS NOT NULL AS linked, problems = '' AS valid, problems,
  sha256(concat('{"arguments":', arguments, ',"id":"', call_id, '","name":"', name, '"}')) AS json_sha256
FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND name = 'merge'
"""


def _op6_sql() -> str:
    q = quality
    known = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in q.COMMON_WORDS.items())
    patterns = [p.replace("\\t-\\r", "\\x09-\\x0D").replace("'", "''") for p in q.CLASSES.values()]
    chain, most = "", max(map(len, q.COMMON_WORDS.values())) + 1
    for i, pattern in enumerate(patterns):
        chain += f", r{i + 1} AS (SELECT *, regexp_replace(s{i}, '{pattern}', '', 'g') AS s{i + 1} FROM r{i})"
    classes = ", ".join(f"length(s{i}) - length(s{i + 1})" for i in range(len(patterns))) + f", length(s{len(patterns)})"
    sums = lambda name, n: ", ".join(f"sum({name}[{i + 1}])" for i in range(n))

    def distance(p: str, r: str) -> str:
        x, y = f"({p}[i] / list_sum({p}))", f"({r}[i] / list_sum({r}))"
        half = lambda v: f"CASE WHEN {v} > 0 THEN {v} * log2({v} / (({x} + {y}) / 2)) ELSE 0 END"
        return f"coalesce(CASE WHEN list_sum({p}) > 0 AND list_sum({r}) > 0 THEN sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({half(x)} + {half(y)}) / 2)))) END, 0)"

    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS s0, CASE WHEN lang IN ({', '.join(repr(k) for k in q.COMMON_WORDS)}) THEN lang ELSE 'other' END AS lang FROM documents
), r0 AS (SELECT *, list_filter(string_split_regex(s0, '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w, coalesce(CASE lang {known} END, []) AS known FROM d){chain}
, h AS (
  SELECT doc_id, lang, s0, w, [{classes}] AS c, list_transform(known, lambda k: len(list_filter(w, lambda x: lower(x) = k))) AS hits FROM r{len(patterns)}
), k AS (SELECT *, list_append(hits, len(w) - coalesce(list_sum(hits), 0)) AS n FROM h
), ref AS (
  SELECT lang, [{sums('c', len(patterns) + 1)}] AS rc, list_filter([{sums('n', most)}], lambda x: x IS NOT NULL) AS rn FROM k WHERE len(w) >= {q.MIN_WORDS} GROUP BY lang
), g AS (
  SELECT doc_id, i, list_slice(w, i, i + {q.WINDOW - 1}) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {q.WINDOW - 2})) AS i FROM k WHERE len(w) >= {q.WINDOW})
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS m FROM g) WHERE m > 1
), rep AS (SELECT doc_id, count(DISTINCT j) AS m FROM (SELECT doc_id, unnest(range(i, i + {q.WINDOW})) AS j FROM twice) GROUP BY doc_id
), ln AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS m FROM (SELECT doc_id, unnest(string_split(s0, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^ \\x09-\\x0D]') GROUP BY doc_id
), f AS (
  SELECT k.doc_id, len(w) AS n_words, length(s0) - c[2] AS word_chars, c[6] AS n_symbols, coalesce(ln.m, 0) AS n_dup_lines, coalesce(rep.m, 0) AS n_repeat_words, {distance('k.c', 'ref.rc')} AS dc, {distance('k.n', 'ref.rn')} AS dw
  FROM k LEFT JOIN ref USING (lang) LEFT JOIN rep ON rep.doc_id = k.doc_id LEFT JOIN ln ON ln.doc_id = k.doc_id
), v AS (SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words < {q.MIN_WORDS} OR (dc <= {q.MOST_CLASS_DISTANCE} + {q.ALLOWANCE} / sqrt(greatest(n_words, 1)) AND dw <= {q.MOST_WORD_DISTANCE} + {q.ALLOWANCE} / sqrt(greatest(n_words, 1)))) AS kept,
  round(dc, 4) AS class_distance, round(dw, 4) AS word_distance FROM v
"""


OP12_SQL = r"""
WITH RECURSIVE o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
  SELECT conv_id, string_split(CAST(conv_id AS VARCHAR), '') AS digits FROM (SELECT DISTINCT conv_id FROM o)
), crc AS (
  SELECT conv_id, 1 AS pos, xor(4294967295, ascii(digits[1])) AS c, 8 AS steps, digits FROM bits
  UNION ALL
  SELECT conv_id, CASE WHEN steps > 0 THEN pos ELSE pos + 1 END,
    CASE WHEN steps > 0 THEN CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END ELSE xor(c, ascii(digits[pos + 1])) END,
    CASE WHEN steps > 0 THEN steps - 1 ELSE 8 END, digits FROM crc WHERE steps > 0 OR pos < len(digits)
), h AS (
  SELECT conv_id, xor(c, 4294967295) % 4 AS h, conv_id - (conv_id % 20 + 20) % 20 AS base FROM crc WHERE steps = 0 AND pos = len(digits)
), rebuilt AS (
  SELECT h.conv_id, 0 AS part, o.i, o.role, o.text FROM h JOIN o ON o.conv_id = h.base AND o.i <= h.h
  UNION ALL
  SELECT h.conv_id, 1, o.i, o.role, o.text FROM h JOIN o ON o.conv_id = h.conv_id AND o.i > h.h
), seq AS (
  SELECT conv_id, list(sha256(concat(length(role), ':', role, text)) ORDER BY part, i) AS s, list(len(regexp_extract_all(text, '[^ \x09-\x0D]+')) ORDER BY part, i) AS w FROM rebuilt GROUP BY conv_id
  UNION ALL SELECT conv_id, [], [] FROM h WHERE conv_id NOT IN (SELECT conv_id FROM rebuilt)
), members AS (
  SELECT conv_id, d, array_to_string(s[:d], ' ') AS node, CASE WHEN d > 0 THEN array_to_string(s[:d - 1], ' ') END AS parent, d = len(s) AS ends, coalesce(w[d], 0) AS words, s[:d] AS path
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM seq)
), nodes AS (
  SELECT node, parent, d AS depth, any_value(path) AS path, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY node, parent, d
), kids AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), sums AS (
  SELECT array_to_string(path[:a], ' ') AS node, sum((n_convs - 1) * words) AS saved, count(*) FILTER (childless) AS leaves
  FROM (SELECT path, n_convs, words, kids.n IS NULL AS childless, unnest(range(0, depth + 1)) AS a FROM nodes LEFT JOIN kids ON kids.parent = node) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids ON kids.parent = n.node JOIN sums s ON s.node = n.node
"""


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), links AS (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2)
  JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * c >= 85 * (nu.n + nv.n - c)
), edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.v FROM reach JOIN edges ON edges.u = reach.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r ON r.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_spread": OP2_SQL, "op6_quality_divergence": _op6_sql(), "op8_tool_links": OP8_SQL, "op12_conversation_trie": OP12_SQL, "op13_ngram_join": OP13_SQL}
