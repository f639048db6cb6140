"""Keyed surrogates for personal data, in SQL functions only.

What a match has that other mentions may share is an entity: an address, a number, a family name, a given name, the domain of a mail
address. An entity is replaced by a draw that depends on a key, its type, its normal form and the number of the attempt,
so it has one surrogate everywhere and in every spelling (coreference). Attempts are 0 but for entities whose draw collides with another's
or with a real entity; those are drawn again, from a larger space, until all surrogates are distinct. Texts are read twice, never
shuffled unless redrawn entities are too many to broadcast.

Not seen are names without a title before them, and numbers that no pattern below describes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, table

#: Types and patterns, the first that matches at a place counts (Java's syntax). Digits stand alone, not within words.
#: Repeated groups are possessive or bounded: Java's regular expressions recurse for each round of others, and a long text would
#: overflow the stack. A mail address is tried only where its chain of words and dots begins, so a long chain is read once.
_ATOM, _OCTET = r"\p{L}\p{N}_%+-", r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": rf"(?<![{_ATOM}])(?<![{_ATOM}]\.)[{_ATOM}]++(?:\.[{_ATOM}]++)*+@(?:[\p{{L}}\p{{N}}-]++\.){{1,126}}\p{{L}}{{2,}}+",
    "ip": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{4}(?:[ -]?\d{4}){3}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\p{L}\p{N}])",
    "national": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\p{L}\p{N}])",
    "name": r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Г-н|Г-жа)\.? \p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)?(?: \p{Lu}\p{Ll}++)?",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A cheap test that no match can fail: each alternative of each pattern has one of these in it (a test draws matches of all of them).
HINT = r"@|\d{3}|\d\.\d|\+\d|[0-9A-Fa-f]:[0-9A-Fa-f:]|[A-Z]{2}\d{2}|Mr|Ms|Miss|Herr|Frau|M[ao]|Mme|S[er]|Г-"

MALE = r"^(?:Mr|Herr|Monsieur|Señor|Sr|Г-н)\b"
#: Given names by script and gender, and syllables for family names: fixed values.
GIVEN = {
    ("latin", "m"): ["Adrian", "Bruno", "Casper", "Dominic", "Emil", "Felix", "Gustav", "Hugo", "Ivan", "Jonas", "Konrad", "Leon", "Marco", "Nils", "Oskar", "Pablo"],
    ("latin", "f"): ["Alma", "Bianca", "Clara", "Daria", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Karina", "Lucia", "Marta", "Nora", "Olivia", "Paula"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь"],
    ("cyrillic", "f"): ["Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Ксения"],
}
SYLLABLES = {"latin": ["bar", "cor", "den", "fal", "gor", "hal", "kem", "lan", "mor", "nel", "per", "ros", "sten", "tal", "ver", "wik"], "cyrillic": ["бар", "вор", "гон", "дем", "зор", "кал", "лан", "мир", "нов", "пет", "рос", "сол", "тал", "фед", "чер", "шем"]}
#: Country codes of one and of two digits (fixed values); all others have three.
CODES_1, CODES_2 = "17", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ROUNDS = 12
#: Redrawn entities that are broadcast; beyond this they are joined by a shuffle.
MOST_BROADCAST = 20_000


def kind_of(m: Column) -> Column:
    """The type of a mention; null for what looks like an account number and has other check digits: it stays as it is."""
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.when(_account_holds(m), F.lit(kind)) if kind == "iban" else F.lit(kind)).otherwise(out)
    return out


def _mod97(text: Column) -> Column:
    """The remainder by 97 of digits and letters, A being 10."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: F.when(c.rlike("[0-9]"), s * 10 + c.try_cast("int")).otherwise(s * 100 + F.ascii(c) - 55) % 97)


def _account_holds(m: Column) -> Column:
    bare = F.replace(m, F.lit(" "), F.lit(""))
    return _mod97(F.concat(F.substr(bare, F.lit(5), F.length(bare)), F.left(bare, F.lit(4)))) == 1


def _entity(kind: str | Column, norm: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), norm.alias("norm"))


def entities_of(kind: Column, m: Column) -> Column:
    """The entities that a mention is made of, as an array of (kind, norm). What makes two mentions one entity: case, punctuation of numbers and titles of names don't count.

    A mail address is itself and its domain; a name is a family, and a given name with its gender; anything else is itself.
    """
    person = F.lower(F.regexp_replace(m, r"^\S+ ", ""))
    given = F.concat(F.when(m.rlike(MALE), "m:").otherwise("f:"), F.regexp_extract(person, r"^(\S+) ", 1))
    family = F.regexp_extract(person, r"(\S+)$", 1)
    digits = F.regexp_replace(m, r"[^\d]", "")
    return (
        F.when(kind == "email", F.array(_entity("email", F.lower(m)), _entity("domain", F.lower(F.regexp_extract(m, "@(.*)$", 1)))))
        .when((kind == "name") & person.contains(" "), F.array(_entity("family", family), _entity("given", given)))
        .when(kind == "name", F.array(_entity("family", family)))
        .when(kind == "ip", F.array(_entity("ip", m)))
        .when(kind == "ipv6", F.array(_entity("ipv6", F.lower(m))))
        .when(kind == "iban", F.array(_entity("iban", F.replace(m, F.lit(" "), F.lit("")))))
        .when((kind == "phone") & m.startswith("+"), F.array(_entity("phone", F.concat(F.lit("+"), digits))))
        .when(kind.isNull(), F.array().cast("array<struct<kind:string,norm:string>>"))
        .otherwise(F.array(_entity(kind, digits)))
    )


def _number(h: Column, at: int, below: int) -> Column:
    return F.conv(F.substring(h, at, 8), 16, 10).cast("long") % below


def _pick(values: list[str], h: Column, at: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_number(h, at, len(values)) + 1).cast("int"))


def _syllables(script: str, h: Column, at: int, number: Column) -> Column:
    """`number` of a script's syllables (16 at most), each from its own digit of the hash."""
    digit = lambda k: F.conv(F.substr(h, F.lit(at) + k, F.lit(1)), 16, 10).cast("int")
    values = F.array(*map(F.lit, SYLLABLES[script]))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.least(number, F.lit(16)) - 1), lambda k: F.element_at(values, digit(k) % len(SYLLABLES[script]) + 1)), "")


def _woven(m: Column, signs: Column, which: str = "[0-9]") -> Column:
    """m with its digits (or what `which` matches), in order, from another string."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda s, c: F.when(c.rlike(which), F.struct(F.concat(s["out"], F.substr(signs, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(F.split(m, ""), start, step, lambda s: s["out"])


def _luhn(body: Column) -> Column:
    """The check digit of a string of digits."""
    step = lambda s, c: F.struct((s["sum"] + F.when(s["odd"], F.when(c > "4", c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))).alias("sum"), (~s["odd"]).alias("odd"))
    total = F.aggregate(F.split(F.reverse(body), ""), F.struct(F.lit(0).alias("sum"), F.lit(True).alias("odd")), step, lambda s: s["sum"])
    return (10 - total % 10) % 10


def drawn(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """What stands for an entity, in its normal form but for case: of its type, script, gender and length. Later attempts draw from larger spaces."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")).cast("binary"), 256)
    digits = F.translate(h, "abcdef", "274905")  # 64 of them
    local = F.concat(F.lower(_pick(GIVEN["latin", "m"] + GIVEN["latin", "f"], h, 1)), F.lit("."), F.substring(h, 17, 10))
    domain = F.concat(F.substr(h, F.lit(33), 4 + 2 * attempt), F.lit(".example."), F.regexp_extract(norm, r"\.([^.]+)$", 1))
    address = F.concat_ws(".", *[(_number(h, 1 + 8 * k, 223 if k == 0 else 254) + 1).cast("string") for k in range(4)])
    address6 = F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substring(h, 1 + 4 * k, 4)) for k in range(6)])
    # letters for letters and digits for digits behind the country and its check digits
    signs = F.transform(F.split(F.substr(norm, F.lit(5), F.length(norm)), ""), lambda c, k: F.when(c.rlike("[0-9]"), F.substr(digits, k + 1, F.lit(1))).otherwise(F.char(F.lit(65) + F.conv(F.substr(h, k + 1, F.lit(1)), 16, 10).cast("int"))))
    account = F.array_join(signs, "")
    country = F.left(norm, F.lit(2))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    size = F.length(norm)
    # a card's first digit, which is its issuer, stays where the length says that it is one
    body = F.concat(F.when(size == 15, F.left(norm, F.lit(2))).otherwise((_number(h, 41, 9) + 1).cast("string")), F.substr(digits, F.lit(2), F.when(size == 15, 12).otherwise(14)))
    wrong = F.when(_luhn(F.left(norm, size - 1)) == F.right(norm, F.lit(1)).cast("int"), 0).otherwise(1)
    card = F.concat(body, ((_luhn(body) + wrong) % 10).cast("string"))
    national = F.concat((_number(h, 41, 9) + 1).cast("string"), F.substring(digits, 2, 8))
    # the country code stays, the rest is drawn
    code = F.when(~norm.startswith("+"), "").when(F.substring(norm, 2, 1).isin(*CODES_1), F.left(norm, F.lit(2))).when(F.substring(norm, 2, 2).isin(*CODES_2), F.left(norm, F.lit(3))).otherwise(F.left(norm, F.lit(4)))
    phone = F.left(F.concat(code, (_number(h, 41, 8) + 2).cast("string"), F.substring(digits, 2, 20)), size)

    def family(script: str) -> Column:
        return F.initcap(_syllables(script, h, 9, 4 + F.floor(attempt / 2).cast("int")))

    def given(script: str) -> Column:
        def of(sex: str) -> Column:
            names = GIVEN[script, sex]
            return F.when(attempt == 0, _pick(names, h, 1)).when(attempt < 3, F.concat(_pick(names, h, 1), F.lit("-"), _pick(names, h, 9))).otherwise(F.concat(_pick(names, h, 1), _syllables(script, h, 17, attempt - 1)))

        return F.when(norm.startswith("m:"), of("m")).otherwise(of("f"))

    cyrillic = norm.rlike(r"\p{IsCyrillic}")
    values = {"email": local, "domain": domain, "ip": address, "ipv6": address6, "iban": iban, "card": card, "national": national, "phone": phone, "family": F.when(cyrillic, family("cyrillic")).otherwise(family("latin"))}
    out = F.when(cyrillic, given("cyrillic")).otherwise(given("latin"))
    for name, value in values.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def written(kind: Column, m: Column, values: Column) -> Column:
    """The mention m with what was drawn for its entities, in its own format."""
    first, second = F.get(values, F.lit(0)), F.get(values, F.lit(1))
    return (
        F.when(kind == "email", F.concat(first, F.lit("@"), second))
        .when(kind == "name", F.concat(F.regexp_extract(m, r"^(\S+ )", 1), F.coalesce(F.concat(second, F.lit(" ")), F.lit("")), first))
        .when(kind.isin("ip", "ipv6"), first)
        .when(kind == "iban", _woven(m, first, "[A-Z0-9]"))
        .when(kind.isNull(), m)
        .otherwise(_woven(m, F.replace(first, F.lit("+"), F.lit(""))))
    )


def found(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _with_entities(mentions: DataFrame) -> DataFrame:
    """(kind, norm) of all entities of a relation with a column m of mentions."""
    return mentions.withColumn("__e", F.explode(entities_of(kind_of(F.col("m")), F.col("m")))).withColumns({"kind": F.col("__e.kind"), "norm": F.col("__e.norm")}).drop("__e")


def draw(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """(kind, norm, drawn, attempt) of every entity, such that surrogates are distinct among themselves and from real entities.

    Given names may be real ones: a person's family name isn't. Draws stand for every spelling of their entity, so what is checked is
    what is written.
    """
    # hashing is dear for its few bytes, so tasks are as many as the session's and not as few as the bytes suggest
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entities = _with_entities(docs.select(F.explode(F.array_distinct(found(F.col(text_column)))).alias("m"))).select("kind", "norm").distinct().repartition(tasks, "kind", "norm").withColumn("attempt", F.lit(0))
    value = F.lower(drawn(key, F.col("kind"), F.col("norm"), F.col("attempt")))
    first = entities = table(entities.withColumn("drawn", value), "entities")
    real = entities.filter("kind != 'given'").select("kind", F.col("norm").alias("taken"))
    # a local part is checked among local parts; that no surrogate is a real address follows from its domain
    for _ in range(ROUNDS):
        # earlier attempts keep what they have; a male and a female name may not share one either
        owners = entities.groupBy("kind", "drawn").agg(F.min(F.struct("attempt", "norm")).alias("owner"), F.count("*").alias("n"))
        known = entities.join(owners, ["kind", "drawn"]).join(real, (entities["kind"] == real["kind"]) & (F.col("drawn") == F.col("taken")), "left").select(entities["*"], ((F.col("owner.norm") != F.col("norm")) | F.col("taken").isNotNull()).alias("again"))
        known = table(known, "checked")
        if not known.filter("again").limit(1).count():
            forget(known)
            return entities
        redrawn = known.withColumn("attempt", F.col("attempt") + F.col("again").cast("int"))
        before, entities = entities, table(redrawn.withColumn("drawn", F.when(F.col("again"), value).otherwise(F.col("drawn"))).drop("again"), "entities")
        forget(known, *([before] if before is not first else []))
    raise RuntimeError("surrogates still collide: the space of some type is too small for its entities")


def replace(docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Texts with surrogates. Returns id, text, n_entities and entities (type:surrogate in order, joined by a bar).

    Null texts stay null, with no entity; texts without a match stay as they are, to the byte. Repeated rows and null ids are
    treated alike. An empty table gives an empty table. Very long words, chains of dots and texts are read in a time that grows with their length.
    """
    light = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    redrawn = table(draw(light, key, "text").filter("attempt > 0").select(F.concat_ws("\x1f", "kind", "norm").alias("entity"), "attempt"), "redrawn")
    many = redrawn.count()
    rows = light.withColumn("__m", found(F.col("text")))
    if many:
        # attempts of each text that has a redrawn entity
        hit = _with_entities(rows.filter(F.size("__m") > 0).select(F.xxhash64("text").alias("__hash"), F.explode(F.array_distinct("__m")).alias("m"))).select("__hash", F.concat_ws("\x1f", "kind", "norm").alias("entity"))
        hit = table(hit.join(F.broadcast(redrawn) if many <= MOST_BROADCAST else redrawn, "entity").groupBy("__hash").agg(F.map_from_entries(F.collect_set(F.struct("entity", "attempt"))).alias("__attempts")), "attempts")
        small = hit.count() <= MOST_BROADCAST
        rows = rows.withColumn("__hash", F.xxhash64("text")).join(F.broadcast(hit) if small else hit, "__hash", "left")
        attempt = lambda e: F.coalesce(F.try_element_at(F.col("__attempts"), F.concat_ws("\x1f", e["kind"], e["norm"])), F.lit(0))
    else:
        attempt = lambda e: F.lit(0)
    kinds = F.transform("__m", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    parts = F.transform("__k", lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), entities_of(x["kind"], x["m"]).alias("of")))
    values = F.transform("__e", lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), F.transform(x["of"], lambda e: drawn(key, e["kind"], e["norm"], attempt(e))).alias("values")))
    new = F.transform("__v", lambda x: F.struct(x["kind"].alias("kind"), written(x["kind"], x["m"], x["values"]).alias("new")))
    rows = rows.withColumn("__k", kinds).withColumn("__e", parts).withColumn("__v", values).withColumn("__new", new)
    # between the matches stands what split leaves; a text begins and ends with such a piece, perhaps an empty one
    pieces = F.split("text", PATTERN, -1)
    woven = F.concat(F.array_join(F.transform("__new", lambda x, k: F.concat(F.get(F.col("__pieces"), k), x["new"])), ""), F.element_at("__pieces", -1))
    rows = rows.withColumn("__pieces", F.when(F.size("__m") > 0, pieces))
    return rows.select(
        F.col("id").alias(id_column),
        F.when(F.size("__m") > 0, woven).otherwise(F.col("text")).alias(text_column),
        F.coalesce(F.size(F.filter("__new", lambda x: x["kind"].isNotNull())), F.lit(0)).cast("long").alias("n_entities"),
        # what has no type is null here, and left out
        F.coalesce(F.array_join(F.transform("__new", lambda x: F.concat(x["kind"], F.lit(":"), x["new"])), "|"), F.lit("")).alias("entities"),
    )
