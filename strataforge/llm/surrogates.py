"""Personal data replaced by keyed surrogates, in DataFrame operations only.

One pattern finds e-mail addresses, phone numbers, card numbers, social security numbers,
IBANs, IP addresses, access keys, assigned secrets, long hexadecimal strings and titled
person names. An entity's canonical form (lower case, digits only and so on) and a secret
key determine its surrogate, so every mention of an entity, however written, gets the same
one. Surrogates keep type and format: digit for digit and letter for letter in the
mention's own punctuation and case, country codes, card issuer digit and check digits,
private address ranges, key prefixes; names keep script, and given names the gender that
the title tells. In a document with a titled name, later bare mentions of the name's parts
are replaced too.

Collision check: over the distinct entities of the whole table, a surrogate that equals an
entity of the same group, or another entity's surrogate, is drawn anew with the next attempt
number until all are distinct. Forms with few values widen after some attempts: e-mail
addresses and names grow longer, addresses of 192.168 and 169.254 move into 10. Attempts
other than 0 are rare; they join the mentions by group and value under a row key of the
operator's own, so null and repeated ids don't matter.

The key. Surrogates are drawn from HMAC-SHA-256 under a secret, that of the argument or of
the session's spark.strataforge.pii.secret (a name that Spark itself redacts); without
either, each call draws a fresh random one, so its surrogates can't be told by anybody nor
be repeated. The key reaches the expressions as a scalar subquery over a local row, so plans
show neither it nor anything derived from it.

Defined results: null text stays null; texts without entities stay as they are; a key that
differs gives other surrogates; empty tables stay empty; columns of any name are kept, and
the count of entities takes the name n_entities, with underscores behind it if that is taken.
"""

from __future__ import annotations

import hashlib
import secrets
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored

# Honorifics, with the gender they tell.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Mme", "Madame", "Mlle", "Frau", "Señora", "Sra", "Госпожа", "Г-жа", "Κυρία"],
    "m": ["Mr", "Sir", "Monsieur", "Herr", "Señor", "Sr", "Господин", "Г-н", "Κύριος"],
    "u": ["Dr", "Prof", "Professor", "Доктор"],
}
_ANY_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=lambda t: (-len(t), t)))
_NAME = r"\p{Lu}[\p{L}’'-]+"
# Each kind's whole form; a mention is tested in this order.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9_/+-]{8,}+",
    "aws": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "hex": r"\b[0-9a-f]{32,64}+\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}+\b",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,12}+(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|(?<![\d.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}+(?![\d-])",
    "person": rf"(?<!\p{{L}})(?:{_ANY_TITLE})\.? {_NAME}(?: {_NAME})?",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
_TITLE_STARTS = "".join(sorted({t[0] for ts in TITLES.values() for t in ts}))
#: A cheap test that every mention passes: most texts stop here, at a character or two a place. Each
#: kind implies one of its forms: e-mail @, phone + or three digits, social security number three digits.
_HINTS = [
    "[@+]",
    r"\d(?:\d\d|\d{0,2}\.\d{1,3}\.\d|(?:[ -]?\d){12})",  # also ip and card
    rf"(?=[psta{_TITLE_STARTS}])(?:password|passwd|pwd|secret|token|api[_-]?key|(?:{_ANY_TITLE})\.? \p{{Lu}})",
    r"(?=[A-Z][A-Z])(?:A(?:KI|SI)A[A-Z0-9]|[A-Z]{2}\d{2}[A-Z0-9]{11})",  # aws and iban
    "[0-9a-f]{32}",
]
HINT = "|".join(_HINTS)
# The letters that made-up names are put together from.
LETTERS = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρστ", "αειου")}
ENDINGS = {"latin": {"f": "a", "m": "n"}, "cyrillic": {"f": "а", "m": "н"}, "greek": {"f": "α", "m": "ς"}}
MAX_ATTEMPTS = 40
LONGER_FROM = 4               # attempts from here on make e-mail and person surrogates longer
WIDER_FROM = 8                # and draw addresses with two fixed parts from 10.0.0.0/8
SECRET_SETTING = "spark.strataforge.pii.secret"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def kind_of(mention: Column) -> Column:
    """The first kind whose form the mention has; bare names have none of the others."""
    out = None
    for kind, pattern in KINDS.items():
        test = mention.rlike(f"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("person")


def _secret_value(mention: Column) -> Column:
    return F.regexp_extract(mention, r"^[A-Za-z_-]+\s{0,2}[=:]\s{0,2}[\"']?(.*)$", 1)


def canonical(kind: Column, mention: Column) -> Column:
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("phone", "card", "ssn"), _digits(mention))
        .when(kind == "secret", _secret_value(mention))
        .otherwise(mention)
    )


def _group(kind: Column) -> Column:
    """Entities of a group must stay distinct; a secret may be a bare hexadecimal string too."""
    return F.when(kind.isin("secret", "hex", "aws"), "key").when(kind.startswith("name"), "name").otherwise(kind)


def _let(value: Column, fn) -> Column:
    """fn(value) with value worked out once, however often fn uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


class Key(NamedTuple):
    """The secret's two HMAC pads, as binary columns."""

    inner: Column
    outer: Column


def session_secret(spark: SparkSession) -> str | None:
    return spark.conf.get(SECRET_SETTING, None)


def _pads(spark: SparkSession, secret: str | None) -> DataFrame:
    """One local row: the HMAC pads of the secret, of a fresh one if it is None."""
    raw = secrets.token_bytes(32) if secret is None else secret.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    row = tuple(bytearray(x ^ pad for x in raw) for pad in (0x36, 0x5C))
    return spark.createDataFrame([row], "inner binary, outer binary")


def _keyed(df: DataFrame, pads: DataFrame) -> DataFrame:
    """df with the key's columns, _inner and _outer."""
    return df.withColumn("_inner", pads.select("inner").scalar()).withColumn("_outer", pads.select("outer").scalar())


def _hash(key: Key, group: Column, value: Column, attempt: Column) -> Column:
    """128 hexadecimal digits that only the key's holder can tell."""

    def mac(i: int) -> Column:
        message = F.concat(F.lit(f"{i}|"), F.concat_ws("|", group, value, attempt.cast("string"))).cast("binary")
        return F.sha2(F.concat(key.outer, F.unhex(F.sha2(F.concat(key.inner, message), 256))), 256)

    return F.concat(mac(0), mac(1))


class _Draw:
    """Numbers drawn from a hash, by place."""

    def __init__(self, digits: Column):
        self.hash = digits

    def at(self, place: Column) -> Column:
        """0 to 65535 for places 1, 2, ...; they repeat after 62."""
        return F.conv(F.substring(self.hash, (F.pmod(place - 1, F.lit(62)) * 2 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _char(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), (F.pmod(number, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))


def _each(value: Column, fn) -> Column:
    """fn(character, place) of every character, joined."""
    places = F.when(F.length(value) > 0, F.sequence(F.lit(1), F.length(value))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: fn(F.substring(value, i, F.lit(1)), i)), "")


_LOWER, _UPPER, _TEN, _HEX, _BASE32 = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _like(value: Column, draw: _Draw) -> Column:
    """Digit for digit, letter for letter, the rest as it is."""
    return _each(value, lambda c, i: F.when(c.rlike("[0-9]"), _char(_TEN, draw.at(i))).when(c.rlike("[a-z]"), _char(_LOWER, draw.at(i))).when(c.rlike("[A-Z]"), _char(_UPPER, draw.at(i))).otherwise(c))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(F.pmod(i, F.lit(2)) == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10))


def _mod_97(value: Column) -> Column:
    """Of the number that the letters and digits stand for, A being 10."""

    def add(total: Column, i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.pmod(total * 10 + c.try_cast("int"), F.lit(97))).otherwise(F.pmod(total * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(F.sequence(F.lit(1), F.length(value)), F.lit(0), add)


def _email(value: Column, attempt: Column, key: Key, draw: _Draw) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    reserved = domain.rlike(r"(?:^|\.)example\.(?:com|net|org)$")
    body, top = F.regexp_extract(domain, r"^(.*)(\.[^.]+)$", 1), F.regexp_extract(domain, r"^(.*)(\.[^.]+)$", 2)
    longer = F.when(attempt >= LONGER_FROM, F.substring(draw.hash, 100, 8)).otherwise("")
    return F.concat(_like(local, draw), longer, F.lit("@"), F.when(reserved, domain).otherwise(F.concat(_let(_hash(key, F.lit("host"), domain, F.lit(0)), lambda h: _like(body, _Draw(h))), top)))


def _card(value: Column, draw: _Draw) -> Column:
    n = F.length(value)
    body = F.concat(F.substring(value, 1, 1), _each(F.substring(value, F.lit(2), n - 2), lambda c, i: _char(_TEN, draw.at(i))))
    off = F.when(_luhn(value) == 0, 0).otherwise(F.pmod(draw.at(F.lit(40)), F.lit(9)) + 1)
    return _let(body, lambda b: F.concat(b, F.pmod(F.pmod(10 - _luhn(F.concat(b, F.lit("0"))), F.lit(10)) + off, F.lit(10)).cast("string")))


def _ip(value: Column, attempt: Column, draw: _Draw) -> Column:
    value = F.when((attempt >= WIDER_FROM) & value.rlike(r"^(?:192\.168|169\.254)\."), "10.0.0.0").otherwise(value)
    kept = F.when(value.rlike(r"^(?:10|127)\."), 1).when(value.rlike(r"^(?:192\.168|169\.254)\."), 2).otherwise(0)
    parts = F.split(value, r"\.")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i <= kept, F.element_at(parts, i)).otherwise((F.pmod(draw.at(i * 3), F.when(i == 1, 223).otherwise(254)) + 1).cast("string"))), ".")


def _iban(value: Column, draw: _Draw) -> Column:
    land = F.substring(value, 1, 2)
    return _let(_like(F.substring(value, F.lit(5), F.length(value) - 4), draw), lambda body: F.concat(land, F.lpad((98 - _mod_97(F.concat(body, land, F.lit("00")))).cast("string"), 2, "0"), body))


def _name(value: Column, kind: Column, attempt: Column, draw: _Draw) -> Column:
    """Syllables in the name's script, about as long; given names end by gender."""
    pairs = F.greatest(F.lit(2), F.ceil(F.length(value) / 2).cast("int")) + F.when(attempt >= LONGER_FROM, 2).otherwise(0)

    def made(script: str) -> Column:
        hard, soft = LETTERS[script]
        body = F.array_join(F.transform(F.sequence(F.lit(1), pairs), lambda i: F.concat(_char(hard, draw.at(i * 2)), _char(soft, draw.at(i * 2 + 1)))), "")
        end = F.when(kind == "name_f", ENDINGS[script]["f"]).when(kind == "name_m", ENDINGS[script]["m"])
        return F.when(kind == "name_f", F.concat(F.substring(body, F.lit(1), F.length(body) - 1), end)).when(kind == "name_m", F.concat(body, end)).otherwise(body)

    return F.when(value.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(value.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def surrogate(kind: Column, value: Column, attempt: Column, key: Key) -> Column:
    """The canonical surrogate of a canonical entity."""
    return _let(_hash(key, _group(kind), value, attempt), lambda h: _drawn(kind, value, attempt, key, _Draw(h)))


def _drawn(kind: Column, value: Column, attempt: Column, key: Key, draw: _Draw) -> Column:
    prefix = F.regexp_extract(value, r"^(1|7|[2-9]\d)", 1)
    return (
        F.when(kind == "email", _email(value, attempt, key, draw))
        .when(kind == "card", _card(value, draw))
        .when(kind == "ip", _ip(value, attempt, draw))
        .when(kind == "iban", _iban(value, draw))
        .when(kind == "aws", F.concat(F.substring(value, 1, 4), _each(F.substring(value, 5, 99), lambda c, i: _char(_BASE32, draw.at(i)))))
        .when(kind == "phone", F.when(F.length(value) > 10, F.concat(prefix, _like(F.substring(value, F.length(prefix) + 1, F.length(value)), draw))).otherwise(_like(value, draw)))
        .when(kind.isin("secret", "hex") & value.rlike("^[0-9a-f]+$"), _each(value, lambda c, i: _char(_HEX, draw.at(i))))
        .when(kind.startswith("name"), _name(value, kind, attempt, draw))
        .otherwise(_like(value, draw))
    )


def written(kind: Column, mention: Column, core: Column) -> Column:
    """The surrogate in the mention's punctuation and case."""
    return _let(core, lambda c: _written(kind, mention, c))


def _written(kind: Column, mention: Column, core: Column) -> Column:
    redone = _each(mention, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(core, F.length(_digits(F.substring(mention, F.lit(1), i))), F.lit(1))).otherwise(c))
    cased = F.when(F.length(core) == F.length(mention), _each(mention, lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(core, i, F.lit(1)))).otherwise(F.substring(core, i, F.lit(1))))).otherwise(core)
    label = F.substring(mention, F.lit(1), F.length(mention) - F.length(_secret_value(mention)))
    return (
        F.when(kind.isin("phone", "card", "ssn"), redone)
        .when(kind == "email", cased)
        .when(kind == "secret", F.concat(label, core))
        .when(kind.startswith("name"), F.when((mention == F.upper(mention)) & (F.length(mention) > 1), F.upper(core)).otherwise(F.initcap(core)))
        .otherwise(core)
    )


def _name_kinds(mentions: Column) -> Column:
    """Of a document's mentions: kind and lower-cased part of each titled name's parts."""
    persons = F.filter(mentions, lambda m: m.rlike(f"^(?:{KINDS['person']})$"))

    def parts(m: Column) -> Column:
        gender = F.when(m.rlike(f"^(?:{'|'.join(TITLES['f'])})\\.? "), "name_f").when(m.rlike(f"^(?:{'|'.join(TITLES['m'])})\\.? "), "name_m").otherwise("name_u")
        names = F.slice(F.split(m, " "), 2, 2)
        return F.transform(names, lambda n, i: F.struct(F.when(i + 1 == F.size(names), "name").otherwise(gender).alias("kind"), F.lower(n).alias("value"), n.alias("mention")))

    return F.array_distinct(F.flatten(F.transform(persons, parts)))


def _mentions(docs: DataFrame) -> DataFrame:
    """Of the documents that HINT doesn't rule out: row (all their columns), text, found
    (mentions, maybe none), names, and gaps (the text around the mentions)."""
    columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    first = docs.where(F.col("text").rlike(HINT)).select(columns, F.col("text")).withColumn("found", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    named = first.withColumn("names", _name_kinds(F.col("found")))
    # bare mentions of titled names join the pattern of their document
    bare = F.array_distinct(F.transform(F.filter("names", lambda n: F.length(n["mention"]) >= 3), lambda n: F.concat(F.lit(r"\Q"), n["mention"], F.lit(r"\E"))))
    pattern = F.when(F.size(bare) > 0, F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), F.array_join(bare, "|"), F.lit(r")(?!\p{L})"))).otherwise(F.lit(PATTERN))
    return (
        named.withColumn("pattern", pattern)
        .withColumn("found", F.when(F.size("names") > 0, F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("found")))
        .withColumn("gaps", F.when(F.size("found") > 0, F.split("text", F.col("pattern"), -1)))
        .select("row", F.when(F.size("found") == 0, F.col("text")).alias("text"), "found", "names", "gaps")
    )


def _entities_of(mention: Column, names: Column) -> Column:
    """The entities of one mention as (kind, value, mention, lead): a titled name has a part or
    two, led by its title and spaces; all other mentions are one entity."""
    kind = kind_of(mention)

    def part(n: Column, lead: Column) -> Column:
        low = F.lower(n)
        known = F.filter(names, lambda x: x["value"] == low)
        return F.struct(F.coalesce(F.try_element_at(known, F.lit(1))["kind"], F.lit("name")).alias("kind"), low.alias("value"), n.alias("mention"), lead.alias("lead"))

    titled = mention.rlike(f"^(?:{KINDS['person']})$")
    words = F.split(mention, " ")
    parts = F.transform(F.slice(words, 2, 2), lambda n, i: part(n, F.when(i == 0, F.concat(words[0], F.lit(" "))).otherwise(" ")))
    one = F.array(F.struct(kind.alias("kind"), canonical(kind, mention).alias("value"), mention.alias("mention"), F.lit("").alias("lead")))
    return F.when(kind != "person", one).when(titled, parts).otherwise(F.array(part(mention, F.lit(""))))


def _all_entities(found: DataFrame, *keys: str) -> DataFrame:
    """keys, e: every entity of the found mentions."""
    some = found.where(F.size("found") > 0)
    return some.select(*keys, F.explode(F.flatten(F.transform("found", lambda m: _entities_of(m, F.col("names"))))).alias("e"))


def entities(docs: DataFrame) -> DataFrame:
    """kind, value of the distinct canonical entities of all texts."""
    return _all_entities(_mentions(docs.select("text"))).select("e.kind", "e.value").distinct()


def attempts(found: DataFrame, pads: DataFrame) -> tuple[DataFrame, str]:
    """Of documents with their mentions: grp, value, attempt of the entities whose attempt
    isn't 0, and the table's path."""
    spark = found.sparkSession

    def drawn(some: DataFrame) -> tuple[DataFrame, str]:
        core = surrogate(F.col("kind"), F.col("value"), F.col("attempt"), Key(F.col("_inner"), F.col("_outer")))
        return stored(_keyed(some, pads).withColumn("core", core).select("grp", "value", "kind", "attempt", "core"), "pii-drawn")

    # the same value may appear as two kinds of a group (a secret that is also a bare hex string)
    known, known_path = stored(_all_entities(found).select("e.kind", "e.value").groupBy(_group(F.col("kind")).alias("grp"), "value").agg(F.min("kind").alias("kind")), "pii-entities")
    now, path = drawn(known.withColumn("attempt", F.lit(0)))
    for _ in range(MAX_ATTEMPTS):
        taken = known.select("grp", F.col("value").alias("core"), F.lit(True).alias("is_entity"))
        first = now.groupBy("grp", "core").agg(F.count("*").alias("n"), F.min("value").alias("holder")).where("n > 1")
        bad = (
            now.join(taken, ["grp", "core"], "left").join(first, ["grp", "core"], "left")
            .withColumn("bad", F.coalesce("is_entity", F.lit(False)) | F.coalesce(F.col("holder") != F.col("value"), F.lit(False)))
        )
        if bad.where("bad").isEmpty():
            break
        again = bad.select("grp", "value", "kind", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"))
        redrawn, new_path = drawn(again)
        discard(spark, path)
        now, path = redrawn, new_path
    else:
        raise RuntimeError("some surrogates still collide; their form has too few values for the entities found")
    discard(spark, known_path)
    return now.where("attempt > 0").select("grp", "value", "attempt"), path


def free_name(name: str, columns: list[str]) -> str:
    """The name, with underscores behind it while a column has it already."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def with_surrogates(docs: DataFrame, secret: str | None = None, count_as: str | None = "n_entities") -> DataFrame:
    """docs with the text's entities replaced; all columns are kept. The number of replaced
    mentions is added as count_as, unless that is None."""
    spark = docs.sparkSession
    pads = _pads(spark, secret if secret is not None else session_secret(spark))
    # each text meets the pattern once; what was found is written with its document
    found, _ = stored(_mentions(docs).withColumn("key", F.expr("uuid()")), "pii-mentions")
    retried, path = attempts(found, pads)
    if retried.isEmpty():
        discard(spark, path)
        found = found.withColumn("tries", F.lit(None).cast("map<string,int>"))
    else:
        # only rows with a redrawn entity get a map
        keyed = _all_entities(found, "key").select("key", _group(F.col("e.kind")).alias("grp"), F.col("e.value").alias("value")).distinct()
        maps = keyed.join(retried, ["grp", "value"]).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "grp", "value"), "attempt"))).alias("tries"))
        found = found.join(maps, "key", "left")
    key = Key(F.col("_inner"), F.col("_outer"))

    def replaced(mention: Column) -> Column:
        def one(e: Column) -> Column:
            attempt = F.coalesce(F.try_element_at(F.col("tries"), F.concat(_group(e["kind"]), F.lit("|"), e["value"])), F.lit(0))
            return F.concat(e["lead"], written(e["kind"], e["mention"], surrogate(e["kind"], e["value"], attempt, key)))

        return F.array_join(F.transform(_entities_of(mention, F.col("names")), one), "")

    pieces = F.zip_with("gaps", F.concat(F.transform("found", replaced), F.array(F.lit(""))), lambda g, s: F.concat(g, s))
    text = F.when(F.size("found") > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    count = [] if count_as is None else [free_name(count_as, docs.columns)]
    changed = _keyed(found, pads).select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns), *(F.size("found").alias(c) for c in count))
    rest = docs.where(~F.coalesce(F.col("text").rlike(HINT), F.lit(False))).select(*(F.col(f"`{c}`") for c in docs.columns), *(F.lit(0).alias(c) for c in count))
    return changed.unionByName(rest)
