"""Personal data replaced by keyed surrogates of the same type and format.

1. Entities are found by one pattern with an alternative per type.
2. What identifies an entity is its type and its canonical form (letters and digits without case and
   punctuation, names with the gender of their title), so that differently written mentions share one
   surrogate. A number is a card only if its check sum holds.
3. The surrogate of a canonical form is derived from a keyed hash: digits stay digits, letters letters;
   card numbers keep their first digit and check sum, addresses stay valid, e-mail addresses
   keep the last label, phone numbers the country code, names get a name of the same gender and script.
4. Collision check over all entities of the corpus: surrogates shared by two entities, or equal
   to an entity, are drawn anew until all differ; addresses and e-mail addresses whose form has few values
   take a wider form then, valid still.
5. Each mention takes its surrogate in its own format (case, blanks, punctuation).

Everything is DataFrame functions. Only texts with entities are joined, by a digest of the text, so
nulls, repeated ids and copies do no harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgrove.llm.common import plain_text
from textgrove.workspace import Workspace

WIDEN = 8  # draws in the entity's own form, before forms with few values become wider
STALLED = 32  # rounds without fewer collisions after which a form counts as exhausted
# Titles by gender and script, and given names that go with them.
TITLES = {
    ("male", "latin"): ("Mr", "Herr", "Señor", "Monsieur"),
    ("female", "latin"): ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame"),
    ("male", "cyrillic"): ("господин",),
    ("female", "cyrillic"): ("госпожа",),
}
GIVEN = {
    ("male", "latin"): "Adam Anton Carl Daniel David Felix Hugo Jonas Leon Lucas Marco Martin Oscar Paul Simon Victor",
    ("female", "latin"): "Ana Clara Diana Elena Emma Eva Julia Laura Lea Lina Maria Marta Nora Olivia Sara Vera",
    ("male", "cyrillic"): "Антон Борис Виктор Денис Иван Максим Олег Павел",
    ("female", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Ольга Юлия",
}
SYLLABLES = {
    "latin": "ba be bo da de di fa fe ga ha ka ko la le lo ma me mi na ne no pa ra re ri sa so ta te va ve wa",
    "cyrillic": "ба бо ва ве га да де за ка ко ла ле ма ми на но па по ра ро са со та то",
}
_TITLE = "(?:" + "|".join(t for titles in TITLES.values() for t in titles) + ")"
_EMAIL = r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
_ACCESS_KEY = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
_SECRET = (
    r"(?<![A-Za-z])(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
    r"(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{6,}"
)
_ADDRESS = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
# What a number that may go on after a blank must not run into.
_FORMED = rf"{_ADDRESS}|{_SSN}|(?<![\w.-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?!\w)"
_CARD = rf"(?<![\w.-])\d(?:[ -]?\d){{12}}(?:[ -]?(?!{_FORMED}|(?<![\w.-])\d(?:[ -]?\d){{12,18}}(?!\w))\d){{0,6}}(?!\w)"
_NEXT = rf"{_FORMED}|{_CARD}"
_FORMED_CODE = rf"{_FORMED}|{_ACCESS_KEY}|\b[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3}}"
_NEXT_WORD = rf"{_TITLE}\.? \p{{Lu}}|{_EMAIL}|{_SECRET}"
_DIALLED = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})"
# The pattern of each type, in the order in which they are tried.
PATTERNS = {
    "email": _EMAIL,
    "access_key": _ACCESS_KEY,
    "secret": _SECRET,
    # the second form is for numbers whose own groups look like something else
    "phone": rf"(?<![\w.])(?:{_DIALLED}(?:[ .-]?(?!{_FORMED})\d{{2,4}}){{2}}(?:[ .-]?(?!{_NEXT})\d{{2,4}}){{0,2}}(?!\w)"
    rf"|{_DIALLED}(?:[ .-]?\d{{2,4}}){{2,4}}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "ssn": _SSN,
    "card": _CARD,
    "address": _ADDRESS,
    "iban": rf"\b[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3}}(?: ?(?!{_FORMED_CODE})[A-Z0-9]{{4}}){{0,2}}"
    rf"(?: ?(?!{_FORMED_CODE}|{_CARD})[A-Z0-9]{{4}}){{0,2}}(?: ?(?!{_FORMED_CODE})[A-Z0-9]{{1,3}})?\b",
    "name": rf"(?<!\p{{L}}){_TITLE}\.? \p{{Lu}}\p{{Ll}}+(?: (?!{_NEXT_WORD})\p{{Lu}}\p{{Ll}}+){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity contains one of these; a scan for them is much cheaper than the whole pattern.
HINT = rf"[0-9@]|AKIA|ASIA|{_TITLE}\.? \p{{Lu}}"


def _kind(surface: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(surface.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return F.coalesce(kind, F.lit("card"))


GENDERED = "|"  # in the canonical form of a name, before what its title tells


def _described(found: DataFrame) -> DataFrame:
    """``surface`` with kind, detail (what of the form is kept), lead (kept text) and canon."""
    rows = found.withColumn("kind", _kind(F.col("surface")))
    surface, kind = F.col("surface"), F.col("kind")
    gender = F.lit(None).cast("string")
    for (sex, script), titles in TITLES.items():
        gender = F.when(surface.rlike(f"^(?:{'|'.join(titles)})\\b"), F.lit(f"{sex} {script}")).otherwise(gender)
    lead = (
        F.when(kind == "secret", F.regexp_extract(surface, r"^([^=:]*[=:]\s*[\"']?)", 1))
        .when(kind == "name", F.regexp_extract(surface, rf"^({_TITLE}\.? )", 1))
        .when(kind == "access_key", F.substring("surface", 1, 4))
        .otherwise("")
    )
    rows = rows.withColumn("lead", lead)
    body = F.expr("substring(surface, length(lead) + 1)")
    rows = rows.withColumn("body", body)
    detail = (
        F.when(kind == "email", F.lower(F.regexp_extract(surface, r"([A-Za-z]+)$", 1)))
        .when(kind == "phone", F.regexp_extract(surface, r"^\+(\d{1,3})", 1))
        .when(kind == "secret", F.when(F.col("body").rlike("^[0-9a-f]+$"), "hex").otherwise("mixed"))
        .when(kind == "name", gender)
        .otherwise("")
    )
    canon = (
        F.when(kind.isin("secret", "access_key", "address"), F.col("body"))
        .when(kind == "name", F.concat(F.lower("body"), F.lit(GENDERED), F.regexp_replace(gender, " .*", "")))
        .otherwise(F.lower(F.regexp_replace("body", "[^A-Za-z0-9]", "")))
    )
    return rows.withColumn("detail", detail).withColumn("canon", canon)


def _draw(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, detail, canon, attempt) with their ``surrogate``."""
    seed = F.concat_ws("|", F.lit(key), "kind", "canon", F.col("attempt").cast("string"))
    blocks = [F.sha2(F.concat(seed, F.lit(f"|{i}")), 256) for i in range(4)]
    rows = entities.withColumn("stream", F.concat(*blocks))

    def value(place):
        at = F.pmod(place, F.lit(128)) * 2 + 1
        return F.conv(F.substring("stream", at, F.lit(2)), 16, 10).cast("int")

    def pick(alphabet, place):
        return F.substring(F.lit(alphabet), F.pmod(value(place), F.lit(len(alphabet))) + 1, F.lit(1))

    def listed(words, place):
        return F.element_at(F.array(*map(F.lit, words)), F.pmod(value(place), F.lit(len(words))) + 1)

    kind, canon = F.col("kind"), F.col("canon")
    kept_front = F.when(kind == "phone", F.length("detail")).when(kind == "card", 1).when(kind == "iban", 2).otherwise(0)
    kept_back = F.when(kind == "email", F.length("detail")).otherwise(0)
    rows = rows.withColumn("front", kept_front).withColumn("back", F.length("canon") - kept_back)

    def letter(c, i):
        small = F.when(F.col("detail") == "hex", pick("abcdef", i)).otherwise(pick("abcdefghijklmnopqrstuvwxyz", i))
        return (
            F.when((i < F.col("front")) | (i >= F.col("back")), c)
            .when(c.rlike("[0-9]"), F.when(i == F.col("front"), pick("123456789", i)).otherwise(pick("0123456789", i)))
            .when(c.rlike("[a-z]"), small)
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i))
            .otherwise(c)
        )

    spelled = F.array_join(F.transform(F.split("canon", ""), letter), "")
    octets = F.transform(
        F.split("canon", r"\."),
        lambda o, i: F.when(F.col("attempt") >= WIDEN, 1 + F.pmod(value(i), F.lit(254)))
        .when(F.length(o) == 1, 1 + F.pmod(value(i), F.lit(9)))
        .when(F.length(o) == 2, 10 + F.pmod(value(i), F.lit(90)))
        .otherwise(100 + F.pmod(value(i), F.lit(155)))
        .cast("string"),
    )
    name = F.lit("")
    for (sex, script), given in GIVEN.items():
        first, parts = given.split(), SYLLABLES[script].split()
        places = F.sequence(F.lit(1), F.least(F.lit(3) + F.col("attempt"), F.lit(12)))
        last = F.initcap(F.array_join(F.transform(places, lambda i: listed(parts, i)), ""))
        words = F.size(F.split(_body("canon"), " "))
        whole = (
            F.when(words == 1, last)
            .when(words == 2, F.concat_ws(" ", listed(first, F.lit(0)), last))
            .otherwise(F.concat_ws(" ", listed(first, F.lit(0)), listed(first, F.lit(13)), last))
        )
        name = F.when(F.col("detail") == f"{sex} {script}", whole).otherwise(name)
    drawn = F.when(kind == "address", F.array_join(octets, ".")).when(kind == "name", name).otherwise(spelled)
    rows = rows.withColumn("drawn", drawn)
    valid = (kind == "card") & (_check_sum(canon) == 0)
    fixed = F.expr("substring(drawn, 1, length(drawn) - 1)")
    digit = F.pmod(F.lit(10) - _check_sum(F.concat(fixed, F.lit("0"))), F.lit(10)).cast("string")
    # short e-mail addresses have few values: later draws get more letters in front
    more = F.sequence(F.lit(WIDEN), F.least(F.col("attempt"), F.lit(WIDEN + 12)))
    more = F.array_join(F.transform(more, lambda i: pick("abcdefghijklmnopqrstuvwxyz", i + 64)), "")
    more = F.when((kind == "email") & (F.col("attempt") >= WIDEN), more).otherwise("")
    surrogate = F.concat(more, F.when(valid, F.concat(fixed, digit)).otherwise(F.col("drawn")))
    return rows.select("kind", "detail", "canon", "attempt", surrogate.alias("surrogate"))


def _body(canon: str) -> Column:
    """A canonical form without the gender that tells names apart."""
    return F.substring_index(canon, GENDERED, 1)


def _check_sum(digits: Column) -> Column:
    """Luhn sum modulo 10."""
    doubled = F.transform(
        F.reverse(F.split(digits, "")),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10


def _assigned(entities: DataFrame, key: str, work: Workspace) -> DataFrame:
    """kind, canon, surrogate: all surrogates of a kind differ from each other and from all entities.

    Rounds go on until none collides; a form without free values left is an error, never a collision.
    """
    state = work.write(_draw(entities.withColumn("attempt", F.lit(0)), key), "drawn_0")
    step, fewest, since = 0, None, 0
    while True:
        step += 1
        twice = state.groupBy("kind", F.lower("surrogate").alias("s"))
        twice = twice.agg(F.min("canon").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        named = state.select("kind", "canon", F.lower("surrogate").alias("s"))
        shared = named.join(twice, ["kind", "s"]).filter("canon <> first").select("kind", "canon")
        real = state.select("kind", F.lower(_body("canon")).alias("s")).distinct()
        taken = named.join(real, ["kind", "s"], "left_semi").select("kind", "canon")
        bad = work.write(shared.union(taken).distinct(), f"bad_{step}")
        left = bad.count()
        if not left:
            break
        fewest, since = (left, step) if fewest is None or left < fewest else (fewest, since)
        if step - since > STALLED:
            raise ValueError(f"{left} entities find no free surrogate of their form")
        good = state.join(bad, ["kind", "canon"], "left_anti")
        again = state.join(bad, ["kind", "canon"], "left_semi").drop("surrogate")
        again = _draw(again.withColumn("attempt", F.lit(step)), key)
        state = work.write(good.unionByName(again), f"drawn_{step}")
    return state.select("kind", "canon", "surrogate")


def _poured(body: Column, surrogate: Column) -> Column:
    """The letters and digits of ``surrogate`` in the places and case of those of ``body``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def step(state, c):
        new = F.substring(surrogate, state["used"] + 1, F.lit(1))
        new = F.when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)
        taken = c.rlike("[A-Za-z0-9]")
        return F.struct(
            F.concat(state["out"], F.when(taken, new).otherwise(c)).alias("out"),
            (state["used"] + taken.cast("int")).alias("used"),
        )

    poured = F.aggregate(F.split(body, ""), start, step)
    return F.concat(poured["out"], F.substring(surrogate, poured["used"] + 1, F.length(surrogate)))


def replaced(
    docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities"
) -> DataFrame:
    """``docs`` with entities in ``text_col`` replaced and ``count_col``, the mentions replaced, added.

    The same entity gets the same surrogate everywhere, different entities different ones; another
    ``key`` gives other surrogates. Null and empty texts and texts without entities stay as they are, with count
    0. All other columns and rows, repeated ones too, stay. An existing ``count_col`` is replaced.
    """
    work = Workspace(docs.sparkSession)
    docs = docs.drop(count_col)
    text = plain_text(text_col)
    has = text.rlike(HINT) & text.rlike(ANY)
    mark, changed_text = (f"{name}_{uuid.uuid4().hex}" for name in ("digest", "text"))  # clash with no column
    hit = docs.filter(has).withColumn(mark, F.sha2(text, 256))
    found = hit.select(F.col(mark).alias("digest"), text.alias("text")).dropDuplicates(["digest"])
    found = found.select(
        "digest",
        F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("mentions"),
        F.split("text", ANY, -1).alias("gaps"),
    )
    found = work.write(found, "found")
    mentions = found.select("digest", F.explode(F.array_distinct("mentions")).alias("surface"))
    surfaces = _described(mentions.select("surface").distinct())
    surfaces = work.write(surfaces.filter((F.col("kind") != "card") | (_check_sum(F.col("canon")) == 0)), "surfaces")
    entities = surfaces.groupBy("kind", "canon").agg(F.min("detail").alias("detail"))
    chosen = _assigned(entities, key, work)
    longer = F.when(F.col("kind") == "email", F.length("surrogate") - F.length("canon")).otherwise(0)
    surrogate, front = F.expr("substring(surrogate, longer + 1)"), F.expr("substring(surrogate, 1, longer)")
    body = F.when(F.col("kind").isin("secret", "access_key", "address", "name"), F.col("surrogate")).otherwise(
        F.concat(front, _poured(F.col("body"), surrogate))
    )
    mapped = surfaces.join(chosen, ["kind", "canon"]).withColumn("longer", longer)
    mapped = mapped.select("surface", F.concat("lead", body).alias("new"))
    mapped = work.write(mapped, "mapped")
    # a mention without a surrogate is a long number that only looked like a card
    by_text = mentions.join(mapped, "surface", "left").withColumn("new", F.coalesce("new", "surface"))
    by_text = by_text.groupBy("digest")
    by_text = by_text.agg(F.map_from_entries(F.collect_list(F.struct("surface", "new"))).alias("new"))
    pieces = F.zip_with(
        "gaps",
        F.transform("mentions", lambda m: F.element_at("new", m)),
        lambda gap, new: F.concat(gap, F.coalesce(new, F.lit(""))),
    )
    done = found.join(by_text, "digest").select(
        F.col("digest").alias(mark),
        F.array_join(pieces, "").alias(changed_text),
        F.size(F.filter("mentions", lambda m: F.element_at("new", m) != m)).cast("long").alias(count_col),
    )
    done = work.write(done, "replaced")
    changed = hit.join(done, mark).drop(mark).withColumn(text_col, F.col(changed_text)).drop(changed_text)
    same = docs.filter(~has).withColumn(count_col, F.lit(0).cast("long"))
    return same.unionByName(changed)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with its columns as they were and entities in ``text_col`` replaced (see replaced)."""
    count = f"n_{uuid.uuid4().hex}"
    return replaced(docs, key, text_col, count).select(*docs.columns)
