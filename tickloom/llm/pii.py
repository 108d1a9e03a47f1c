"""Personal data replaced by keyed surrogates.

Entities are found by patterns; a normal form (lower-case address, digits of a number) says which mentions are the same
entity. Every distinct entity gets one surrogate, drawn from a keyed hash: letters become letters of the same script, case
and vowel class, digits digits, a card number keeps a right check digit, an IP address its kind, a given name stays within
its gender and script. Distinct entities of a type must have distinct surrogates, and none may be an entity of the corpus;
those that fail are drawn again with the next attempt number while that settles half of them or more; what is left is ranked and
given the unused values of its format, and of a longer form when the format has none left. A mention is then written in its own format with
the surrogate of its entity, the same in all documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import numbered, written

ATTEMPTS = 32
#: Given names by gender and script. Surrogates go round within a list.
GIVEN = {
    ("f", "latin"): ("Alice", "Barbara", "Carmen", "Claire", "Emily", "Ingrid", "Jennifer", "Juliette", "Laura", "Linda", "Margaret", "Monika", "Patricia", "Sabine", "Sophie", "Susan"),
    ("m", "latin"): ("Albert", "Antonio", "Charles", "David", "Étienne", "Heinrich", "James", "John", "Jürgen", "Michael", "Pablo", "Peter", "Pierre", "Richard", "Robert", "William"),
    ("f", "cyrillic"): ("Анна", "Екатерина", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Татьяна"),
    ("m", "cyrillic"): ("Александр", "Андрей", "Борис", "Владимир", "Дмитрий", "Иван", "Николай", "Сергей"),
}
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora", "Sr", "Sra", "Don", "Doña")
_NAMES = "|".join(n for names in GIVEN.values() for n in names)
_TITLES = "|".join(TITLES)
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SECRETS = "(?:password|passwd|secret|token|api_key)"
#: In order of precedence where they could start at the same place. Each begins with a test of one or two characters, so that
#: the longer looks behind are taken at few places.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": rf"AKIA[0-9A-Z]{{16}}|(?<=[=:])(?<=\b{_SECRETS}[=:])[^\s\"']{{6,}}|(?<=\")(?<=\b{_SECRETS} ?[=:] ?\")[^\s\"]{{6,}}|(?<![0-9A-Za-z])[0-9a-f]{{40}}(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "iban": r"(?=[A-Z]{2}[0-9]{2})(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9])[3-6][0-9]{3}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}(?![0-9])",
    "ssn": r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "phone": r"(?:(?<![0-9])\+[0-9]{1,3}[ .\-]?)?(?<![0-9])\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![0-9])|(?<![0-9])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9])",
    "given": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_NAMES})(?=\s\p{{Lu}}\p{{L}}+)",
    "surname": rf"(?=\p{{Lu}})(?<=\s)(?<=(?<!\p{{L}})(?:{_TITLES})\.?\s)\p{{Lu}}\p{{L}}+|(?=\p{{Lu}})(?<=\s)(?<=(?<!\p{{L}})(?:{_NAMES})\s)\p{{Lu}}\p{{L}}+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must have for any pattern to fit: one of these characters, the start of a key, a run of hexadecimal letters, or a
#: title or given name before a capital.
CHARACTER_HINT = "[0-9@=:\"]|AKIA|[a-f]{40}"
NAME_HINT = rf"(?<!\p{{L}})(?:{_TITLES}|{_NAMES})\.?\s\p{{Lu}}"
#: Of the names, only given ones are in a list; a title before one leaves it a given name.
_FULL = {k: f"^(?:{PATTERNS[k]})$" for k in ("email", "ip", "ssn")}


def kind(entity: Column) -> Column:
    """The type of a match of ``ANY``, told from its own form; null for a card number with a wrong check digit, which is none."""
    digits = F.regexp_count(entity, F.lit("[0-9]"))
    return (
        F.when(entity.rlike(_FULL["email"]), "email").when(entity.rlike(_FULL["ip"]), "ip").when(entity.rlike(_FULL["ssn"]), "ssn")
        .when(entity.isin(*[n for names in GIVEN.values() for n in names]), "given")
        .when(entity.rlike(r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$") & ~entity.startswith("AKIA"), "iban")
        .when(entity.rlike(r"^[3-6][0-9 \-]+$") & (digits >= 13), F.when(F.pmod(luhn_sum(F.regexp_replace(entity, "[^0-9]", "")), F.lit(10)) == 0, "card")).when(entity.rlike(r"^[+(0-9][0-9 ().\-]+$"), "phone")
        .when(entity.rlike(r"^\p{Lu}\p{L}+$"), "surname").otherwise("secret")
    )


def normal(kind: Column, entity: Column) -> Column:
    """One form for all mentions of an entity."""
    return (
        F.when(kind == "email", F.lower(entity)).when(kind.isin("card", "phone", "ssn"), F.regexp_replace(entity, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(entity, " ", "")).otherwise(entity)
    )


_ROUNDS = ("bcdfghjklmnpqrstvwxz", "aeiouy", "бвгджзклмнпрстфхцчшщ", "аеиоуыэюя", "βγδζθκλμνξπρστφχψ", "αεηιουω", "éèêáàâíóôúûñçäöüß")
ROUNDS = (*_ROUNDS, *(r.upper() for r in _ROUNDS[:-1]), "ÉÈÊÁÀÂÍÓÔÚÛÑÇÄÖÜ", "0123456789")


def _stream(secret: str, *parts: Column) -> Column:
    """256 hex digits of a keyed hash."""
    text = F.concat_ws("\x1f", F.lit(secret), *[p.cast("string") for p in parts])
    return F.concat(*[F.sha2(F.concat(F.lit(f"{i}\x1f"), text), 256) for i in range(4)])


def _draw(stream: Column, i: Column, n: Column) -> Column:
    """A number below ``n`` for place ``i``; the stream goes round after 84 places with another stride."""
    at = F.pmod(i * 3 + F.floor(i / 84), F.lit(252)) + 1
    return F.pmod(F.conv(F.substring(stream, at.cast("int"), F.lit(4)), 16, 10).cast("int") + F.floor(i / 84).cast("int"), n).cast("int")


def scramble(text: Column, stream: Column, hexadecimal: Column | None = None) -> Column:
    """Each letter or digit to one of its own kind, other characters as they are."""

    def one(c, i):
        out = c
        for members in reversed(ROUNDS):
            drawn = F.substring(F.lit(members), _draw(stream, i, F.lit(len(members))) + 1, F.lit(1))
            out = F.when(F.lit(members).contains(c), drawn).otherwise(out)
        if hexadecimal is not None:
            out = F.when(hexadecimal & c.rlike("[0-9a-f]"), F.substring(F.lit("0123456789abcdef"), _draw(stream, i, F.lit(16)) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """Sum that a card number leaves modulo 10, its last digit counting once."""
    n = F.char_length(digits)
    return F.aggregate(
        F.split(digits, ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")),
        lambda acc, c: F.struct(
            (acc["sum"] + F.when(F.pmod(n - acc["i"], F.lit(2)) == 0, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")).otherwise(F.coalesce(c.cast("int"), F.lit(0)))).alias("sum"),
            (acc["i"] + 1).alias("i"),
        ),
    )["sum"]


def surrogate(kind: Column, norm: Column, attempt: Column, secret: str) -> Column:
    """The normal form of an entity's replacement."""
    stream = _stream(secret, kind, norm, attempt)
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    top = F.substring_index(domain, ".", -1)
    email = F.concat(scramble(local, stream), F.lit("@"), scramble(F.substring(domain, F.lit(1), F.char_length(domain) - F.char_length(top) - 1), _stream(secret, F.lit("domain"), domain)), F.lit("."), top)
    octet = lambda i, low, n: (F.lit(low) + _draw(stream, F.lit(i), F.lit(n))).cast("string")
    private = F.regexp_extract(norm, r"^(10|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.", 1)
    public = F.concat_ws(".", octet(0, 11, 110), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254))
    ip = F.when(private == "10", F.concat_ws(".", private, octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254))).when(private != "", F.concat_ws(".", private, octet(2, 0, 256), octet(3, 1, 254))).otherwise(public)
    body = F.concat(F.substring(norm, 1, 1), scramble(F.substring(norm, F.lit(2), F.char_length(norm) - 2), stream))
    card = F.concat(body, F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))
    code = F.when(F.char_length(norm) > 10, F.substring(norm, F.lit(1), F.char_length(norm) - 10)).otherwise("")
    phone = F.concat(code, scramble(F.substring(norm, F.char_length(code) + 1, F.lit(64)), stream))
    given = F.lit(None).cast("string")
    for names in GIVEN.values():
        turn = 1 + F.pmod(F.conv(F.substring(_stream(secret, F.lit(names[0])), 1, 4), 16, 10).cast("int"), F.lit(len(names) - 1))
        ring = F.array(*map(F.lit, names))
        given = F.when(norm.isin(*names), F.get(ring, F.pmod(F.array_position(ring, norm).cast("int") - 1 + turn, F.lit(len(names))).cast("int"))).otherwise(given)
    hexadecimal = norm.rlike("^[0-9a-f]{16,}$")
    secret_text = F.concat(F.when(norm.startswith("AKIA"), "AKIA").otherwise(""), scramble(F.when(norm.startswith("AKIA"), F.substring(norm, F.lit(5), F.lit(64))).otherwise(norm), stream, hexadecimal))
    iban = F.concat(F.substring(norm, 1, 2), scramble(F.substring(norm, F.lit(3), F.lit(64)), stream))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "given", given)
        .when(kind == "secret", secret_text).when(kind == "iban", iban).otherwise(scramble(norm, stream))
    )


def write_like(kind: Column, mention: Column, drawn: Column) -> Column:
    """``drawn``, a normal form, in the format of ``mention``: its separators and its case."""
    signs = F.split(mention, "")
    fill = F.aggregate(
        signs, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.when(
            c.rlike("[0-9A-Za-z]"), F.struct(F.concat(acc["out"], F.substring(drawn, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))),
        # a longer form ends with what the mention has no place for
        lambda acc: F.concat(acc["out"], F.substring(drawn, acc["at"], F.lit(1 << 20))),
    )
    cased = F.array_join(F.transform(signs, lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(drawn, i + 1, F.lit(1)))).otherwise(F.substring(drawn, i + 1, F.lit(1)))), "")
    same = F.char_length(mention) == F.char_length(drawn)
    return F.when(kind.isin("card", "phone", "ssn", "iban"), fill).when((kind == "email") & same & (mention != F.lower(mention)), cased).otherwise(drawn)


#: Places of a format that are not characters of a round.
WIDE = {
    "p": [str(i) for i in range(11, 121)], "o": [str(i) for i in range(256)], "h": [str(i) for i in range(1, 255)], "x": list("0123456789abcdef"),
    "l": list("abcdefghijklmnopqrstuvwxyz"), "L": list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "0": list("0123456789"),
}
#: Values tried for each entity at first, and how many times as many in the next round.
TRIED, GROWTH, CHUNK = 4, 8, 4096


def _format(kind: Column, norm: Column, level: Column, secret: str) -> Column:
    """What all surrogates that an entity may have look like: prefix, skeleton (one sign for each place), mode and suffix.

    Level 0 is the format of ``surrogate``; higher ones are longer or wider, for formats that are full or have one value only.
    """
    skeleton = lambda text: F.array_join(F.transform(F.split(text, ""), lambda c: reduce(lambda out, r: F.when((c != "") & F.lit(r).contains(c), F.lit(r[0])).otherwise(out), reversed(ROUNDS), c)), "")
    form = lambda prefix, bones, mode="own", suffix="": F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in (("prefix", prefix), ("skeleton", bones), ("mode", mode), ("suffix", suffix))])
    first = lambda n: F.substring(norm, 1, n)
    after = lambda n: F.substring(norm, F.lit(n + 1), F.lit(1 << 20))
    domain = F.concat(F.lit("@"), F.substring_index(surrogate(kind, norm, F.lit(0), secret), "@", -1))
    private = F.regexp_extract(norm, r"^(10|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.", 1)
    dotted, ten, six = F.concat(private, F.lit(".")), form("10.", "o.o.h", "wide"), form("fd", "xx:xxxx:xxxx::xxxx", "wide")
    code = F.when(F.char_length(norm) > 10, F.substring(norm, F.lit(1), F.char_length(norm) - 10)).otherwise("")
    rest = F.substring(norm, F.char_length(code) + 1, F.lit(64))
    hexadecimal = norm.rlike("^[0-9a-f]{16,}$")
    own = (
        F.when(kind == "email", form("", skeleton(F.substring_index(norm, "@", 1)), "own", domain))
        .when(kind == "ip", F.when(private == "10", ten).when(private != "", form(dotted, "o.h", "wide")).otherwise(form("", "p.o.o.h", "wide")))
        .when(kind == "card", form(first(1), skeleton(F.substring(norm, F.lit(2), F.char_length(norm) - 2))))
        .when(kind == "phone", form(code, skeleton(rest)))
        .when(kind == "iban", form(first(2), skeleton(after(2))))
        .when((kind == "secret") & norm.startswith("AKIA"), form("AKIA", skeleton(after(4))))
        .when((kind == "secret") & hexadecimal, form("", F.regexp_replace(norm, ".", "x"), "wide"))
        .otherwise(form("", skeleton(norm)))
    )
    longer = (
        F.when(kind == "email", form("", "l" * 16, "wide", domain)).when(kind == "ip", F.when((private != "") & (level == 1), ten).otherwise(six))
        .when(kind == "card", form(first(1), "0" * 17, "wide")).when(kind == "phone", form(code, F.concat(F.regexp_replace(rest, ".", "0"), F.lit("0" * 6)), "wide"))
        .when(kind == "iban", form(first(2), "0" * 24, "wide")).when(kind == "ssn", form("", "0" * 15, "wide"))
        .when(kind == "surname", form("", "L" + "l" * 15, "wide")).otherwise(form("", "l" * 16, "wide"))
    )
    return F.when(level == 0, own).otherwise(longer)


def _places(form: Column) -> Column:
    """The values that each place of a format may have."""
    pick = lambda c, sets: reduce(lambda out, s: F.when(c == s[0], F.array(*map(F.lit, s[1]))).otherwise(out), sets, F.array(c))
    own, wide = [(r[0], list(r)) for r in ROUNDS], list(WIDE.items())
    return F.transform(F.split(form["skeleton"], ""), lambda c: F.when(form["mode"] == "own", pick(c, own)).otherwise(pick(c, wide)))


def _value(kind: Column, form: Column, number: Column, stream: Column) -> Column:
    """The value of a format with this number; different numbers below its size give different values."""

    def place(acc, values):
        n = F.size(values)
        digit = F.pmod(acc["rest"], n.cast("long"))
        at = F.pmod(digit + _draw(stream, acc["i"], n), n.cast("long")).cast("int")
        return F.struct(F.concat(acc["out"], F.get(values, at)).alias("out"), ((acc["rest"] - digit) / n).cast("long").alias("rest"), (acc["i"] + 1).alias("i"))

    start = F.struct(F.lit("").alias("out"), number.cast("long").alias("rest"), F.lit(0).alias("i"))
    text = F.concat(form["prefix"], F.aggregate(_places(form), start, place)["out"], form["suffix"])
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(text, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    return F.when(kind == "card", F.concat(text, check)).otherwise(text)


def _unused(left: DataFrame, taken: DataFrame, secret: str) -> list[DataFrame]:
    """(kind, norm, drawn) for all of ``left`` (kind, norm): the n-th of a format gets its n-th value that is not ``taken`` (kind, drawn).

    So many values of a format are listed as could be enough, then more, at most all; who finds none takes the next longer format.
    """
    done: list[DataFrame] = []
    left = left.select("kind", "norm", F.lit(0).alias("level"), F.lit(0).alias("round"))
    while True:
        formed = left.withColumn("form", _format(F.col("kind"), F.col("norm"), F.col("level"), secret))
        formed = formed.withColumn("key", F.sha2(F.to_json(F.struct("kind", "form")), 256)).withColumn("order", F.sha2(F.concat_ws("\x1f", F.lit(secret), "kind", "norm"), 256))
        formed = written(formed, "formed")
        space = F.least(F.aggregate(_places(F.col("form")), F.lit(1.0), lambda n, values: n * F.size(values)), F.lit(float(1 << 50))).cast("long")
        wanted = F.least(F.count(F.lit(1)) * TRIED * F.pow(F.lit(float(GROWTH)), F.min("round")), F.lit(float(1 << 50))).cast("long")
        groups = formed.groupBy("key", "kind", "form").agg(wanted.alias("wanted")).withColumn("space", space)
        groups = written(groups.withColumn("n", F.least("wanted", "space")), "formats")
        numbers = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))).repartition("key", "chunk")
        numbers = numbers.withColumn("number", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("n")) - 1)))
        value = _value(F.col("kind"), F.col("form"), F.col("number"), _stream(secret, F.col("key")))
        listed = numbers.select("kind", "key", value.alias("drawn")).groupBy("kind", "drawn").agg(F.min("key").alias("key"))
        listed = written(listed.join(reduce(DataFrame.unionByName, [d.select("kind", "drawn") for d in done], taken), ["kind", "drawn"], "left_anti"), "unused")
        ranked = numbered(listed, "key", ["drawn"], "rank").select("key", "rank", "drawn")
        given = numbered(formed, "key", ["order"], "rank").join(ranked, ["key", "rank"], "left").join(groups.select("key", (F.col("n") == F.col("space")).alias("full")), "key")
        given = written(given.select("kind", "norm", "level", "round", "drawn", "full"), "given")
        done.append(given.where("drawn IS NOT NULL").select("kind", "norm", "drawn"))
        left = given.where("drawn IS NULL").select("kind", "norm", (F.col("level") + F.col("full").cast("int")).alias("level"), F.when(F.col("full"), 0).otherwise(F.col("round") + 1).alias("round"))
        if not left.limit(1).count():
            return done


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, norm, drawn) of distinct entities (kind, norm): distinct within a kind, and none an entity itself."""
    left = written(entities.select("kind", "norm").distinct().withColumn("attempt", F.lit(0)), "entities")
    real = left.select("kind", F.col("norm").alias("drawn"), F.lit(True).alias("_real"))
    done: list[DataFrame] = []
    n_left = left.count()
    for _ in range(ATTEMPTS):
        # the two copies of one drawing must be the same, so they are written before they are compared
        tried = written(left.withColumn("drawn", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), secret)), "drawn")
        taken = reduce(DataFrame.unionByName, [d.select("kind", "drawn") for d in done], real.select("kind", "drawn")).distinct().withColumn("_taken", F.lit(True))
        first = tried.groupBy("kind", "drawn").agg(F.min("norm").alias("_first"))
        judged = tried.join(first, ["kind", "drawn"]).join(taken, ["kind", "drawn"], "left")
        fine = (F.col("norm") == F.col("_first")) & (F.col("_taken").isNull() | (F.col("kind") == "given"))
        judged = written(judged.withColumn("_fine", fine).select("kind", "norm", "attempt", "drawn", "_fine"), "judged")
        done.append(judged.where("_fine").select("kind", "norm", "drawn"))
        left = judged.where("NOT _fine").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))
        n_before, n_left = n_left, left.count()
        if not n_left:
            return reduce(DataFrame.unionByName, done)
        if 2 * n_left > n_before:  # most of what they could draw is taken
            break
    taken = reduce(DataFrame.unionByName, [d.select("kind", "drawn") for d in done], real.select("kind", "drawn"))
    return reduce(DataFrame.unionByName, [*done, *_unused(left, taken, secret)])


def replace_entities(docs: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text (with surrogates), n_entities, kinds (sorted, one for each entity found).

    A null text stays null with no entities. Texts without entities come back as they are and take no part in any shuffle. Rows that
    repeat an id are told apart by their text, and equal ones come back equal. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hinted = F.col("text").rlike(CHARACTER_HINT) | F.col("text").rlike(NAME_HINT)
    any_hit = F.coalesce(hinted & F.col("text").rlike(ANY), F.lit(False))
    clean = rows.where(~any_hit)
    clean = clean.select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    hit = rows.where(any_hit).select("doc_id", F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1)).alias("ents"), F.split("text", ANY).alias("gaps"))
    hit = hit.withColumn("kinds", F.transform("ents", kind)).withColumn("norms", F.zip_with("kinds", "ents", normal))
    hit = written(hit.withColumn("row", F.sha2(F.to_json(F.struct("doc_id", "ents", "gaps")), 256)), "found")
    each = hit.select("row", F.explode(F.arrays_zip(F.col("kinds").alias("kind"), F.col("norms").alias("norm"))).alias("e")).select("row", "e.kind", "e.norm").where("kind IS NOT NULL")
    drawn = surrogates(each, secret)
    known = each.distinct().join(drawn, ["kind", "norm"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("kind", "norm").alias("key"), "drawn"))).alias("known"))
    joined = hit.join(known, "row", "left")
    new = F.transform(
        F.arrays_zip(F.col("kinds").alias("kind"), F.col("norms").alias("norm"), F.col("ents").alias("mention")),
        lambda e: F.when(e["kind"].isNull(), e["mention"]).otherwise(
            write_like(e["kind"], e["mention"], F.element_at(F.col("known"), F.struct(e["kind"].alias("kind"), e["norm"].alias("norm"))))
        ),
    )
    text = F.array_join(F.zip_with("gaps", new, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    changed = joined.select("doc_id", text.alias("text"), F.size(F.array_compact("kinds")).cast("long").alias("n_entities"), F.array_sort(F.array_compact("kinds")).alias("kinds"))
    return clean.unionByName(changed)
