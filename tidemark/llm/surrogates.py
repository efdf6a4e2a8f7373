"""Keyed, type-consistent surrogates for personal data, in DataFrame functions only.

Entities are found by one regular expression: e-mail, IPv4 and IPv6 addresses, payment cards,
telephone and social-security numbers, bank accounts, secrets, names after a title, and
names that begin with one of a list of given names. Other names are not found.
A mention has parts (a name: given and family name; an e-mail address: itself and its
domain; else itself) with a kind and a canonical form, so all mentions of an entity, in whatever format, get one surrogate
(coreference). The surrogate follows from SHA-512 of key, kind, canonical form and
attempt. It keeps what the kind asks for: length, character classes and separators,
the gender of the given name or else of the title, the script of names, the check digits of
cards (Luhn) and bank accounts (mod 97). So that none is somebody's, surrogates stay in ranges that are
never given out: domains in .example, addresses in 240.0.0.0/4 and 2001:db8::/32,
social-security numbers from 900 on, ten-digit telephone numbers whose area code begins with 0 or 1.

Collision checks run over the table of distinct parts: a surrogate that a smaller part
of its kind has too, or that is itself a part in the corpus, is drawn again with the
next attempt until none is left. From attempt WIDER on a surrogate has one more character or
syllable with each attempt (an IP address is one of 2001:db8::/32), so however many entities a
corpus has, the draws end. Only parts with later attempts (as a rule none) are joined back; otherwise texts are replaced in place, without a shuffle.

Defined results: null texts stay null, texts without entities stay as they are; repeated
rows are treated alike; an empty table gives an empty result; other columns pass
through untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.binding import let
from tidemark.llm.shared import keep

WIDER = 8
#: Titles that come before names, by gender.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof"],
}
#: Given names that begin a person's name without a title, by gender.
GIVEN = {
    "f": "Anna Maria Laura Julia Sarah Emma Sophie Marie Claire Elena Olga Irina Lucia Carmen Isabel Rosa Katharina Ingrid Petra Monika Alice Emily Jane Mary Elizabeth Susan Linda Karen Nancy Helen".split(),
    "m": "John James Robert Michael William David Richard Thomas Charles Daniel Paul Mark George Peter Hans Karl Klaus Jürgen Wolfgang Stefan Pierre Jean Jacques Michel Carlos José Juan Luis Miguel Pedro".split(),
}
#: Syllables of names by script, and endings of given names by gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ha he ka ke la le lo ma me mi na ne no ra re ri ro sa se ta te to va ve vi wa za".split(),
    "cyrillic": "ба бе бо да де до га ге ка ке ла ле ло ма ме ми на не но ра ре ри ро са се та те то ва ве ви за".split(),
    "greek": "βα βε βο δα δε δο γα γε κα κε λα λε λο μα με μι να νε νο ρα ρε ρι ρο σα σε τα τε το".split(),
}
ENDINGS = {"latin": {"m": "n", "f": "a", "n": "e"}, "cyrillic": {"m": "н", "f": "а", "n": "е"}, "greek": {"m": "ς", "f": "α", "n": "ε"}}
_TITLE = "(?:" + "|".join(t for x in TITLES.values() for t in x) + ")\\.?"
_GIVEN = "(?:" + "|".join(n for x in GIVEN.values() for n in x) + ")"
_HEX = "[0-9A-Fa-f]{1,4}"
_SECRET = "(?:sk|pk|ghp|gho|AKIA|xox[bp])[-_]?"
#: In the order in which they are tried at a place; an e-mail address begins where its characters do, or where the last entity ends. An IPv6 address is one of 2000::/3, fc00::/7 or fe80::/10 and the like, as "a::b" is not one in prose.
PATTERNS = {
    "email": "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: [0-9]{1,3}|[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2}(?: [0-9]{3}|[A-Z0-9]{3}))(?![A-Za-z0-9])",
    "secret": f"(?<![A-Za-z0-9])(?:[0-9a-f]{{32,64}}|{_SECRET}[A-Za-z0-9]{{16,64}})(?![A-Za-z0-9])",
    "card": "(?<![0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": "(?:\\+[0-9]{1,3}[ .-]?)?\\([0-9]{3}\\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])(?:\\+[0-9]{1,3}[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])|\\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    "ip6": f"(?<![A-Za-z0-9:.])(?:[23][0-9A-Fa-f]{{3}}|[Ff][CcDdEe][0-9A-Fa-f]{{2}})(?:(?::{_HEX}){{7}}|(?::{_HEX}){{0,5}}::{_HEX}(?::{_HEX}){{0,5}})(?![A-Za-z0-9:])",
    "ip": "(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\\.[0-9])",
    "person": f"(?=\\p{{Lu}})(?<![\\p{{L}}])(?:{_TITLE} \\p{{Lu}}[\\p{{L}}'-]+(?![\\p{{L}}0-9])(?: \\p{{Lu}}[\\p{{L}}'-]+(?![\\p{{L}}0-9]))?|{_GIVEN} \\p{{Lu}}[\\p{{L}}'-]+(?![\\p{{L}}0-9]))",
}
#: What is asked first: an entity begins after other than a letter or digit, where the last one ends, or with one of these.
ANY = "(?:(?<![A-Za-z0-9])|\\G|(?=[0-9+(\\p{Lu}]))(?:" + "|".join(PATTERNS.values()) + ")"
#: What every entity contains: texts without it aren't searched. All texts are, for this, so names are only tried at capitals after other than a letter.
HINT = f"[0-9@]|:[A-Fa-f]{{0,4}}:|(?<![A-Za-z0-9])(?:[a-f]{{32}}|{_SECRET}[A-Za-z]{{16}}|(?=\\p{{Lu}})(?:{_TITLE}|{_GIVEN}) )"
_DIGITS = ("card", "ssn", "phone")
_P = "__pii_"
_PART = "struct<kind:string,form:string>"


def _kind(m: Column) -> Column:
    return reduce(lambda c, k: c.when(m.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)), PATTERNS, F).otherwise("person")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _script(name: Column) -> Column:
    return F.when(name.rlike("^\\p{IsCyrillic}"), "cyrillic").when(name.rlike("^\\p{IsGreek}"), "greek").otherwise("latin")


def _gender(m: Column) -> Column:
    """The gender of the given name, else of the title."""
    title = lambda g: m.rlike("^(?:" + "|".join(TITLES[g]) + ")\\.? ")
    given = F.regexp_extract(m, f"^(?:{_TITLE} )?(\\S+) ", 1)
    return F.when(given.isin(*GIVEN["f"]), "f").when(given.isin(*GIVEN["m"]), "m").when(title("m"), "m").when(title("f"), "f").otherwise("n")


def _groups(address: Column) -> Column:
    """An IPv6 address with all its eight groups of four digits."""
    halves = F.split(F.lower(address), "::")
    left, right = F.split(halves[0], ":"), F.coalesce(F.split(F.get(halves, F.lit(1)), ":"), F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.lpad(g, 4, "0")), ":")


def _parts(m: Column, kind: Column | None = None) -> Column:
    """Kinds and canonical forms of a mention's parts. kind: its _kind(), where it is bound already."""
    if kind is None:
        return let(_kind(m), lambda kind: _parts(m, kind))
    part = lambda k, form: F.struct(k.alias("kind"), form.alias("form"))
    digits = _digits(m)
    form = F.when(kind == "email", F.lower(m)).when(kind == "phone", F.when(F.length(digits) > 10, F.right(digits, F.lit(10))).otherwise(digits)).when(kind.isin(*_DIGITS), digits).when(kind == "iban", F.regexp_replace(m, " ", "")).when(kind == "ip6", _groups(m)).otherwise(m)
    names = F.split(F.regexp_replace(m, f"^{_TITLE} ", ""), " ")
    family = F.element_at(names, -1)
    family_part = part(F.concat(F.lit("family:n:"), _script(family)), F.lower(family))
    given_part = part(F.concat(F.lit("given:"), _gender(m), F.lit(":"), _script(names[0])), F.lower(names[0]))
    person = F.when(F.size(names) > 1, F.array(given_part, family_part)).otherwise(F.array(family_part))
    email = F.array(part(kind, form), part(F.lit("domain"), F.split(form, "@")[1]))
    return F.when(kind == "person", person).when(kind == "email", email).otherwise(F.array(part(kind, form)))


def _byte(h: Column, i: Column) -> Column:
    return F.conv(F.substr(h, 2 * (i % 64) + 1, F.lit(2)), 16, 10).cast("int")


def _draw(text: Column, h: Column) -> Column:
    """Every letter and digit replaced by one of its class."""
    def char(c: Column, i: Column) -> Column:
        v = _byte(h, i)
        return F.when(c.rlike("[0-9]"), (v % 10).cast("string")).when(c.rlike("[a-z]"), F.char(97 + v % 26)).when(c.rlike("[A-Z]"), F.char(65 + v % 26)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), char), "")


def _luhn(digits: Column) -> Column:
    """Fifteen digits and their check digit."""
    total = F.aggregate(F.transform(F.split(digits, ""), lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")).otherwise(c.cast("int"))), F.lit(0), lambda a, b: a + b)
    return F.concat(digits, ((10 - total % 10) % 10).cast("string"))


def _mod97(text: Column) -> Column:
    """The remainder of digits and letters (A is 10) read as a number."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _name(kind: Column, h: Column, more: Column) -> Column:
    gender, script = F.split(kind, ":")[1], F.split(kind, ":")[2]

    def of(s: str) -> Column:
        syllables, n = F.array(*map(F.lit, SYLLABLES[s])), len(SYLLABLES[s])
        two = lambda k: F.element_at(syllables, (_byte(h, 2 * k) * 256 + _byte(h, 2 * k + 1)) % n + 1)
        end = F.when(kind.startswith("given"), reduce(lambda c, g: c.when(gender == g, F.lit(ENDINGS[s][g])), ENDINGS[s], F).otherwise("")).otherwise("")
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), 3 + more), two), ""), end)

    return reduce(lambda c, s: c.when(script == s, of(s)), SYLLABLES, F).otherwise(of("latin"))


def surrogate(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of a part; that of an e-mail address keeps the domain, which is a part of its own."""
    return let(F.sha2(F.concat_ws("\x1f", F.lit(key), kind, form, attempt.cast("string")), 512), lambda h: _surrogate(kind, form, attempt, h))


def _surrogate(kind: Column, form: Column, attempt: Column, h: Column) -> Column:
    """surrogate() from the hash of key, kind, form and attempt."""
    more = F.greatest(attempt - (WIDER - 1), F.lit(0)).cast("int")
    drawn = F.concat(_draw(form, h), F.substr(F.translate(h, "abcdef", "012345"), F.lit(101), more))
    parts = F.split(form, "@")
    email = F.concat(_draw(parts[0], h), F.substr(h, F.lit(101), more), F.lit("@"), parts[1])
    domain = F.concat(F.substr(h, F.lit(101), more), F.regexp_replace(_draw(form, h), "\\.[^.]*$", ".example"))
    ip6 = F.concat(F.lit("2001:db8::"), F.substr(h, F.lit(101), F.lit(4)), F.lit(":"), F.substr(h, F.lit(105), F.lit(4)), F.lit(":"), F.substr(h, F.lit(109), F.lit(4)))
    ip = F.when(more > 0, ip6).otherwise(F.concat_ws(".", (240 + _byte(h, F.lit(0)) % 15).cast("string"), *(_byte(h, F.lit(i)).cast("string") for i in (1, 2, 3))))
    groups = F.concat_ws(":", F.lit("2001:db8"), F.concat(F.lit("8"), F.substr(h, F.lit(1), F.lit(3))), *(F.substr(h, F.lit(4 * i + 1), F.lit(4)) for i in range(1, 6)))  # the 8 keeps it apart from ip6
    secret = F.when(form.rlike("^[0-9a-f]+$"), F.substr(F.concat(h, F.sha2(h, 512)), F.lit(1), F.length(form) + more)).otherwise(F.concat(F.regexp_extract(form, f"^{_SECRET}", 0), _draw(F.regexp_replace(form, f"^{_SECRET}", ""), h), F.substr(h, F.lit(101), more)))
    checked = _luhn(F.concat(F.lit("9"), F.substr(drawn, F.lit(2), F.lit(14))))
    card = F.when(F.length(form) == 16, F.concat(checked, F.substr(drawn, F.lit(17), more))).otherwise(drawn)
    country, account = F.substr(form, F.lit(1), F.lit(2)), F.substr(drawn, F.lit(5), F.length(drawn))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    rest = F.substr(drawn, F.lit(2), F.length(drawn))
    phone = F.when(F.length(form) == 10, F.concat((_byte(h, F.lit(50)) % 2).cast("string"), rest)).otherwise(drawn)
    return F.when(kind == "email", email).when(kind == "domain", domain).when(kind == "ip6", groups).when(kind == "ip", ip).when(kind == "secret", secret).when(kind == "card", card).when(kind == "iban", iban).when(kind == "phone", phone).when(kind == "ssn", F.concat(F.lit("9"), rest)).otherwise(_name(kind, h, more))


def _fill(mention: Column, chars: str, value: Column) -> Column:
    """A mention with its last characters of a class replaced, one by one, by those of a value; a value with more characters stands as it is."""
    count = lambda t: F.length(F.regexp_replace(t, f"[^{chars}]", ""))

    def filled(kept: Column) -> Column:
        def char(c: Column, i: Column) -> Column:
            nth = count(F.substr(mention, F.lit(1), i + 1)) - kept
            return F.when(c.rlike(f"[{chars}]") & (nth > 0), F.substr(value, nth, F.lit(1))).otherwise(c)

        return F.when(kept < 0, value).otherwise(F.array_join(F.transform(F.split(mention, ""), char), ""))

    return let(count(mention) - F.length(value), filled)


def _render(mention: Column, attempts: Column, key: str) -> Column:
    """What stands for a mention. attempts: array of the parts that need later attempts."""
    def value(p: Column) -> Column:
        later = F.get(F.filter(attempts, lambda a: (a["kind"] == p["kind"]) & (a["form"] == p["form"])), F.lit(0))["attempt"]
        return let(F.coalesce(later, F.lit(0)), lambda attempt: surrogate(p["kind"], p["form"], attempt, key))

    def of(kind: Column, values: Column) -> Column:
        title = F.regexp_extract(mention, f"^{_TITLE} ", 0)
        shout = F.regexp_replace(mention, f"^{_TITLE} ", "").rlike("^[\\p{Lu} '-]+$")
        names = F.array_join(F.transform(values, lambda v: F.when(shout, F.upper(v)).otherwise(F.initcap(v))), " ")
        email = F.concat(F.split(values[0], "@")[0], F.lit("@"), F.get(values, F.lit(1)))
        return F.when(kind == "person", F.concat(title, names)).when(kind == "email", email).when(kind.isin(*_DIGITS), _fill(mention, "0-9", values[0])).when(kind == "iban", _fill(mention, "A-Z0-9", values[0])).otherwise(values[0])

    # a value is used for each of its characters, so it is bound: once a mention and not once a character
    return let(_kind(mention), lambda kind: let(F.transform(_parts(mention, kind), value), lambda values: of(kind, values)))


def _mentions(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def assign(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The distinct parts of the table with their surrogates: `kind`, `form`, `attempt`, `surrogate`; surrogates of a kind are distinct and no parts of the table."""
    parts = docs.select(F.explode(_mentions(F.col(text_col))).alias("m")).distinct().select(F.explode(_parts(F.col("m"))).alias("p")).select("p.*").distinct()
    table = keep(parts.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("form"), F.col("attempt"), key)))
    forms = table.select(F.split("kind", ":")[0].alias("base"), F.col("form").alias("surrogate")).distinct().withColumn("real", F.lit(True))
    while True:
        base = F.split("kind", ":")[0]
        taken = table.groupBy(base.alias("base"), "surrogate").agg(F.min(F.struct("attempt", "kind", "form")).alias("first"), F.count("*").alias("n"))
        taken = taken.join(forms, ["base", "surrogate"], "left").filter("n > 1 OR real")
        if taken.isEmpty():
            return table
        bad = table.withColumn("base", base).join(taken, ["base", "surrogate"], "left")
        again = F.coalesce("real", F.lit(False)) | ((F.col("n") > 1) & ~((F.col("first.kind") == F.col("kind")) & (F.col("first.form") == F.col("form"))))
        bad = bad.select("kind", "form", (F.col("attempt") + F.coalesce(again, F.lit(False)).cast("int")).alias("attempt"))
        table = keep(bad.withColumn("surrogate", surrogate(F.col("kind"), F.col("form"), F.col("attempt"), key)))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count: bool = False) -> DataFrame:
    """The rows of `docs` with surrogates in place of entities; with `count` also `n_replaced` (a column of that name goes)."""
    if not key:
        raise ValueError("a secret key is needed")
    docs = docs.drop("n_replaced") if count else docs
    later = assign(docs, key, text_col).filter("attempt > 0").select("kind", "form", "attempt")
    none = F.array().cast("array<struct<kind:string,form:string,attempt:int>>")
    df = docs.withColumn(f"{_P}mentions", _mentions(F.col(text_col)))
    if later.isEmpty():
        df = df.withColumn(f"{_P}later", none)
    else:
        df = df.withColumn(f"{_P}id", F.coalesce(F.col(id_col).cast("string"), F.lit("-"))).withColumn(f"{_P}text", F.xxhash64(text_col))
        rows = [f"{_P}id", f"{_P}text"]
        found = df.select(*rows, F.explode(f"{_P}mentions").alias("m")).distinct().select(*rows, F.explode(_parts(F.col("m"))).alias("p")).select(*rows, "p.*").distinct()
        found = found.join(later, ["kind", "form"]).groupBy(*rows).agg(F.collect_list(F.struct("kind", "form", "attempt")).alias(f"{_P}found"))
        df = df.join(found, rows, "left").withColumn(f"{_P}later", F.coalesce(f"{_P}found", none))
    gaps = F.split(F.col(text_col), ANY, -1)
    filled = F.transform(f"{_P}mentions", lambda m: _render(m, F.col(f"{_P}later"), key))
    text = F.array_join(F.zip_with(gaps, filled, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    text = F.when(F.size(f"{_P}mentions") > 0, text).otherwise(F.col(text_col))
    out = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return df.select(*out, *([F.size(f"{_P}mentions").cast("long").alias("n_replaced")] if count else []))
