"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Entities found in a text are replaced by values of the same kind and format, drawn
by a secret key, so that one entity has one surrogate everywhere: digits become
digits, letters become letters of the same script and case, addresses stay valid,
card numbers keep their check sum's state, phone numbers their country, names
their title. A name's parts are units of their own, whatever title stands before
them; a given name takes the gender that all titles of the table before it agree
on. Where a text has a person with a title, later mentions of the name, or of a
part of it, without one are replaced too. Units (an address, a surname, ...) whose
surrogate another unit of any kind also got, or that exists as a real unit, are
drawn again until all differ; so a surrogate depends on the key, the entity and,
where it was drawn again, on the units it met.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsluice.llm.common import Scratch, text_or_empty

#: Titles before a name, and the gender they tell. Fixed values.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н")
FEMALE = ("Mrs", "Miss", "Ms", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "г-жа")
NEUTRAL = ("Dr", "Prof")

_TITLES = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}[\p{Ll}\p{M}]+(?:-\p{Lu}[\p{Ll}\p{M}]+)?"

#: Kinds and their patterns, in order of preference.
PATTERNS = {
    # labels and dots in one class: a group repeated without bound would use the stack of the matcher
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-][\p{L}\p{N}.-]*(?<!\.)\.\p{L}{2,}",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w.-])(?:\d{4}[ -]?){3}\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(.-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-])",
    "key": r"(?<!\w)[0-9a-f]{32,64}(?!\w)",
    "name": rf"(?<!\p{{L}})(?:{_TITLES})\.? {_NAME}(?: {_NAME})?(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has some of: texts without it need no search.
HINT = rf"[@\d]|[a-f]{{32}}|{_TITLES}"
#: Words that can be a part of a name.
MENTION = rf"(?<![\p{{L}}\p{{M}}]){_NAME}(?![\p{{L}}\p{{M}}])"

LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
CYR_LOWER, CYR_UPPER = "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"
GREEK_LOWER, GREEK_UPPER = "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
CASED = {
    "Cyrillic": (CYR_LOWER, CYR_UPPER),
    "Greek": (GREEK_LOWER, GREEK_UPPER),
    "Armenian": ("".join(map(chr, range(0x561, 0x587))), "".join(map(chr, range(0x531, 0x557)))),
}
#: Letters of scripts without case.
PLAIN = {
    script: "".join(map(chr, codes))
    for script, codes in {
        "Arabic": range(0x628, 0x63B),
        "Hebrew": range(0x5D0, 0x5EB),
        "Devanagari": range(0x915, 0x939),
        "Thai": range(0xE01, 0xE2F),
        "Hiragana": range(0x304B, 0x3063),
        "Katakana": range(0x30AB, 0x30C3),
        "Hangul": range(0xAC00, 0xD7A4, 97),
        "Han": range(0x4E00, 0x9FA6, 131),
    }.items()
}
#: Consonants, vowels, and the endings of female, male and other given names.
SYLLABLES = {
    "Latin": ("bdfgklmnprstvz", "aeiou", ("na", "n", "l")),
    "Cyrillic": ("бвгдзклмнпрст", "аеиоу", ("на", "н", "ль")),
    "Greek": ("βγδζθκλμνπρστ", "αειου", ("να", "νος", "λι")),
}
ROUNDS = 64


def _stream(key: str, kind: Column, unit: Column, attempt: Column) -> Column:
    """128 keyed hexadecimal digits of a unit."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, unit, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\x1f+")), 256))


def _draw(stream: Column, i: Column, alphabet: str) -> Column:
    """A keyed character for place i."""
    v = F.conv(F.substring(stream, F.pmod(i * 4, F.lit(125)) + 1, F.lit(4)), 16, 10).cast("int")
    return F.substring(F.lit(alphabet), v % len(alphabet) + 1, F.lit(1))


def _chars(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))


def scramble(raw: Column, stream: Column, digits: str = DIGITS) -> Column:
    """Each digit and letter replaced by one of its class; all else stays in place."""

    def one(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), _draw(stream, i, digits))
        for pattern, alphabet in (("[a-z]", LOWER), ("[A-Z]", UPPER)):
            out = out.when(c.rlike(pattern), _draw(stream, i, alphabet))
        out = out.when(~c.rlike(r"\p{L}"), c)
        for script, (lower, upper) in CASED.items():
            out = out.when(c.rlike(rf"[\p{{Is{script}}}&&\p{{Lu}}]"), _draw(stream, i, upper)).when(
                c.rlike(rf"\p{{Is{script}}}"), _draw(stream, i, lower)
            )
        for script, letters in PLAIN.items():
            out = out.when(c.rlike(rf"\p{{Is{script}}}"), _draw(stream, i, letters))
        return out.when(c.rlike(r"\p{Lu}"), _draw(stream, i, UPPER)).when(c.rlike(r"\p{L}"), _draw(stream, i, LOWER)).otherwise(c)

    return F.array_join(F.transform(_chars(raw), one), "")


def _luhn(x: Column) -> Column:
    digits = F.reverse(F.regexp_extract_all(x, F.lit("[0-9]"), F.lit(0)))
    values = F.transform(
        digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int"))
    )
    return F.aggregate(values, F.lit(0), lambda s, v: s + v) % 10


def _card(raw: Column, stream: Column) -> Column:
    new = scramble(raw, stream)
    last = F.pmod(F.substring(new, -1, 1).cast("int") - _luhn(new) + _luhn(raw), F.lit(10))
    return F.concat(F.substring(new, F.lit(1), F.char_length(new) - 1), last.cast("string"))


def _ip(stream: Column) -> Column:
    octet = lambda i: F.conv(F.substring(stream, 1 + 4 * i, 4), 16, 10).cast("int") % 254 + 1
    return F.concat_ws(".", *(octet(i).cast("string") for i in range(4)))


def _after(raw: Column, head: str, stream: Column) -> Column:
    """What ``head`` matches stays, the rest is scrambled."""
    kept = F.regexp_extract(raw, head, 0)
    return F.concat(kept, scramble(F.substring(raw, F.char_length(kept) + 1, F.char_length(raw)), stream))


def _given(raw: Column, gender: Column, stream: Column) -> Column:
    """A given name with the ending of its gender, in the script of the original."""

    def name(script: str) -> Column:
        consonants, vowels, (female, male, other) = SYLLABLES[script]
        body = F.concat(*(x for i in range(3) for x in (_draw(stream, F.lit(2 * i), consonants), _draw(stream, F.lit(2 * i + 1), vowels))))
        return F.concat(F.initcap(body), F.when(gender == "f", F.lit(female)).when(gender == "m", F.lit(male)).otherwise(F.lit(other)))

    return (
        F.when(raw.rlike(r"^\p{IsLatin}"), name("Latin"))
        .when(raw.rlike(r"^\p{IsCyrillic}"), name("Cyrillic"))
        .when(raw.rlike(r"^\p{IsGreek}"), name("Greek"))
        .otherwise(scramble(raw, stream))
    )


def surrogate(kind: Column, unit: Column, raw: Column, gender: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a unit, written in the format of ``raw``."""
    # bound once: what stands in a lambda is computed again for every character
    bound = F.transform(F.array(_stream(key, kind, unit, attempt)), lambda s: _surrogate(kind, raw, gender, s))
    return F.element_at(bound, 1)


def _surrogate(kind: Column, raw: Column, gender: Column, s: Column) -> Column:
    tld = F.regexp_extract(raw, r"\.\p{L}{2,}$", 0)
    return (
        F.when(kind == "email", F.concat(scramble(F.substring(raw, F.lit(1), F.char_length(raw) - F.char_length(tld)), s), tld))
        .when(kind == "ip", _ip(s))
        .when(kind == "card", _card(raw, s))
        .when(kind == "phone", _after(raw, r"^(?:\+\d{1,3})?", s))
        .when(kind == "iban", _after(raw, r"^[A-Z]{2}", s))
        .when(kind == "key", F.array_join(F.transform(_chars(raw), lambda c, i: _draw(s, i, HEX)), ""))
        .when(kind == "given", _given(raw, gender, s))
        .otherwise(scramble(raw, s))
    )


def _kind(raw: Column) -> Column:
    kinds = [(k, raw.rlike(f"^(?:{p})$")) for k, p in PATTERNS.items()]
    return reduce(lambda out, x: out.when(x[1], F.lit(x[0])), kinds[1:], F.when(kinds[0][1], F.lit(kinds[0][0])))


def _title(raw: Column) -> Column:
    return F.regexp_extract(raw, rf"^(?:{_TITLES})\.? ", 0)


def _parts(raw: Column) -> Column:
    """The names of a person, given ones first."""
    return F.split(F.regexp_replace(raw, rf"^(?:{_TITLES})\.? ", ""), " ")


def _units(raws: DataFrame) -> DataFrame:
    """raw, kind, place, unit, part, gender: one row for most entities; names have a row for each name in them."""
    title = F.regexp_extract("raw", rf"^({_TITLES})", 1)
    gender = F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f")
    typed = raws.withColumn("kind", _kind(F.col("raw")))
    whole = typed.filter("kind <> 'name'").select(
        "raw", "kind", F.lit(0).alias("place"), F.lower("raw").alias("unit"), F.col("raw").alias("part"), F.lit(None).cast("string").alias("gender")
    )
    last = F.size(_parts(F.col("raw"))) - 1
    people = (
        typed.filter("kind = 'name'")
        .select("raw", gender.alias("gender"), last.alias("last"), F.posexplode(_parts(F.col("raw"))).alias("place", "part"))
        .select("raw", F.when(F.col("place") == F.col("last"), "surname").otherwise("given").alias("kind"), "place", F.lower("part").alias("unit"), "part", "gender")
    )
    return whole.unionByName(people)


def _settle(units: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """kind, unit, gender, attempt such that all surrogates differ from each other and from all units, of whatever kind.
    A surrogate once fixed keeps its place: later attempts give way to it."""
    made = lambda df: df.withColumn("made", F.lower(surrogate(F.col("kind"), F.col("unit"), F.col("unit"), F.col("gender"), key, F.col("attempt"))))
    agreed = F.when(F.min("gender") == F.max("gender"), F.min("gender")).otherwise("n").alias("gender")
    now = scratch.save(made(units.groupBy("kind", "unit").agg(agreed).withColumn("attempt", F.lit(0))), "units0")
    for r in range(1, ROUNDS + 1):
        real = now.select(F.col("unit").alias("u")).distinct()
        first = Window.partitionBy("made").orderBy("attempt", "kind", "unit")
        judged = (
            now.withColumn("turn", F.row_number().over(first))
            .join(real, F.col("made") == F.col("u"), "left")
            .withColumn("again", (F.col("turn") > 1) | F.col("u").isNotNull())
            .select("kind", "unit", "gender", "attempt", "made", "again")
        )
        judged = scratch.save(judged, f"judged{r}")
        scratch.drop(f"units{r - 1}", f"judged{r - 1}")
        if judged.filter("again").isEmpty():
            return judged.select("kind", "unit", "gender", "attempt")
        redrawn = made(judged.filter("again").select("kind", "unit", "gender", (F.col("attempt") + 1).alias("attempt")))
        now = scratch.save(judged.filter("not again").select("kind", "unit", "gender", "attempt", "made").unionByName(redrawn), f"units{r}")
    raise ValueError(f"surrogates still collide after {ROUNDS} rounds: too many entities for their format")


def _mentions(hit: DataFrame, written: DataFrame) -> DataFrame:
    """rid, known: for texts with people, the surrogates of the parts of their names that stand elsewhere in the text."""
    people = F.filter("raws", lambda x: _title(x) != "")
    pairs = F.flatten(F.transform(people, lambda x: F.transform(_parts(x), lambda y, i: F.struct(y.alias("part"), F.when(i == F.size(_parts(x)) - 1, "surname").otherwise("given").alias("kind")))))
    words = F.flatten(F.transform("gaps", lambda g: F.regexp_extract_all(g, F.lit(MENTION), F.lit(0))))
    asked = (
        hit.filter(F.exists("raws", lambda x: _title(x) != ""))
        .select("rid", F.array_distinct(pairs).alias("pairs"), F.array_distinct(words).alias("words"))
        .select("rid", F.explode(F.filter("pairs", lambda p: F.array_contains("words", p["part"]))).alias("p"))
        .select("rid", "p.part", "p.kind")
    )
    # a part that is both a surname and a given name there is taken for the surname
    one = asked.join(written, ["kind", "part"]).groupBy("rid", "part").agg(F.max_by("new", "kind").alias("new"))
    return one.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("part", "new"))).alias("known"))


def replace_pii(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with replaced texts, and n_entities and entity_kinds (sorted) added.

    n_entities counts entities and mentions without a title. Texts without entities pass
    as they are, unshuffled; null stays null with no entities. All columns stay, except
    that the two new ones replace any of the same name; an empty table gives no rows.
    Repeated rows are replaced alike. Every text is searched once.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rest = [c for c in docs.columns if c not in ("n_entities", "entity_kinds")]
    row = F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row")
    text = text_or_empty(text_col)
    raws = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = scratch.save(docs.select(row, raws.alias("raws")), "found")
    clean = found.filter(F.size("raws") == 0).select("row", F.col("row")[text_col].alias("new"), F.lit(0).alias("n_entities"), F.lit("").alias("entity_kinds"))
    gaps = F.split(F.col("row")[text_col].cast("string"), ANY, -1)
    hit = scratch.save(found.filter(F.size("raws") > 0).select("row", gaps.alias("gaps"), "raws", F.monotonically_increasing_id().alias("rid")), "hit")
    seen = hit.select("rid", F.posexplode("raws").alias("at", "raw"))
    units = scratch.save(_units(seen.select("raw").distinct()), "units")
    attempts = _settle(units, key, scratch)
    drawn = scratch.save(
        units.drop("gender")
        .join(attempts, ["kind", "unit"])
        .withColumn("new", surrogate(F.col("kind"), F.col("unit"), F.col("part"), F.col("gender"), key, F.col("attempt")))
        .select("raw", "kind", "place", "part", "new"),
        "drawn",
    )
    parts = (
        drawn.groupBy("raw")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "new"))), lambda x: x["new"]), " ").alias("new"),
            F.max(F.when(F.col("kind").isin("given", "surname"), "name").otherwise(F.col("kind"))).alias("kind"),
        )
        .withColumn("new", F.concat(F.when(F.col("kind") == "name", _title(F.col("raw"))).otherwise(""), F.col("new")))
    )
    table = scratch.save(parts, "table")
    mapped = (
        seen.join(table, "raw")
        .groupBy("rid")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("news"),
            F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("entity_kinds"),
        )
    )
    known = _mentions(hit, drawn.filter(F.col("kind").isin("given", "surname")).select("kind", "part", "new").distinct())

    def rewritten(gap: Column) -> Column:
        """A gap with the mentions in it replaced."""
        others, words = F.split(gap, MENTION, -1), F.regexp_extract_all(gap, F.lit(MENTION), F.lit(0))
        return F.array_join(F.zip_with(others, words, lambda g, w: F.concat(g, F.coalesce(F.try_element_at("known", w), w, F.lit("")))), "")

    mentions = F.aggregate(
        "gaps", F.lit(0), lambda n, g: n + F.size(F.filter(F.regexp_extract_all(g, F.lit(MENTION), F.lit(0)), lambda w: F.map_contains_key("known", w)))
    )
    joined = F.array_join(F.zip_with("between", "news", lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    changed = (
        hit.join(mapped, "rid")
        .join(known, "rid", "left")
        .withColumn("between", F.when(F.col("known").isNull(), F.col("gaps")).otherwise(F.transform("gaps", rewritten)))
        .withColumn("n_entities", F.size("raws") + F.when(F.col("known").isNull(), 0).otherwise(mentions))
        .select("row", joined.alias("new"), "n_entities", "entity_kinds")
    )
    return clean.unionByName(changed).select(
        *((F.col("new") if c == text_col else F.col("row")[c]).alias(c) for c in rest), "n_entities", "entity_kinds"
    )
