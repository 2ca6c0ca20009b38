"""Surrogates for personal data: every detected entity is replaced by a made-up one of the same type, script, format and gender.

Detection is one regular expression per text. The parts of an entity that carry identity (units: a mailbox, a domain, a number, a
given name, a surname) go into one dictionary over the whole corpus, so that a unit has the same surrogate wherever it
stands, alone or within a longer entity. A surrogate is drawn from a keyed hash of the unit. It is rejected if it is the unit itself, a real unit
of the corpus, or taken by another unit; rejected units draw again until all surrogates are distinct. Given names are permuted within
their list of one gender and script, which keeps them distinct by construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from macrospark.llm.common import cut_lineage, kept, let

# Titles with the gender they tell, given names by script and gender, alphabets.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Sr", "Sra", "Monsieur", "Madame", "Mme",
          "Господин", "Госпожа", "г-н", "г-жа"]
GIVEN = {
    "given_m_latin": ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Peter",
                      "Paul", "Hans", "Klaus", "Stefan", "Pierre", "Jean", "Luc", "Carlos", "Juan", "Pedro", "Luis", "Miguel"],
    "given_f_latin": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Anna", "Emma",
                      "Julia", "Sabine", "Ursula", "Monika", "Marie", "Sophie", "Claire", "Camille", "Carmen", "Lucía", "Sofía", "Elena"],
    "given_m_cyrillic": ["Иван", "Алексей", "Дмитрий", "Сергей", "Андрей", "Николай", "Михаил", "Павел"],
    "given_f_cyrillic": ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"],
}
#: A character is replaced by one of its own line.
ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóúàèìòùâêîôûäëïöü", "çñß", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ",
             "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
             "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗", "アイウエオカキクケコサシスセソタチツテトナニヌネノ", "김이박최정강조윤장임한오서신권황안송류홍"]
#: Slavic endings that tell a surname's gender; they stay.
ENDINGS = "(?:ова|ева|ина|ская|ая|ов|ев|ин|ский|ий)$"

_NAME = r"\p{Lu}[\p{L}'’-]+"
_MAIL = r"[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+"
_IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
_PHONE = r"(?:\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{3,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})"
_SOCIAL = r"\d{3}-\d{2}-\d{4}"
_CARD = r"\d(?:[ \-]?\d){12,18}"
_SECRET = r"""(?:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}["']?"""
_KEY = r"AKIA[0-9A-Z]{16}"
_NUMBER_END = r"(?![\p{L}\p{N}]|[.\-]\d)"
ENTITY = (rf"(?<![\p{{L}}\p{{N}}._%+\-])(?:{_MAIL}|(?:{_IP}|{_SOCIAL}|{_CARD}){_NUMBER_END}|{_KEY}(?![0-9A-Z])"
          rf"|(?i:{_SECRET})[A-Za-z0-9_\-+/]{{8,}}"
          rf"|(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? {_NAME}(?: {_NAME}){{0,2}}"
          rf"|(?:{'|'.join(n for names in GIVEN.values() for n in names)}) {_NAME})|(?<![\p{{L}}\p{{N}}]){_PHONE}{_NUMBER_END}")

_WORD_EDGE = r"(?<!\p{L})(?=\p{L})|(?<=\p{L})(?!\p{L})"

#: Draws after which a surrogate grows longer (where its format allows), may equal a real unit, and after which the search ends.
LONGER, REAL, MOST = 4, 8, 64


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits modulo 10; the last digit counts once."""
    worth = lambda d, i: F.when(F.pmod(F.length(digits) - i, F.lit(2)) == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    each = F.transform(F.split(digits, ""), lambda c, i: worth(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def entity_type(e: Column) -> Column:
    """mail, ip, phone, social, card, secret or name; null for what only looks like one (a number that fails its checks)."""
    digits = F.regexp_replace(e, r"\D", "")
    octets = F.forall(F.split(e, r"\."), lambda o: o.cast("int") <= 255)
    return (F.when(e.contains("@"), "mail").when(e.rlike(rf"^{_IP}$"), F.when(octets, "ip")).when(e.rlike(rf"^{_PHONE}$"), "phone")
            .when(e.rlike(rf"^{_SOCIAL}$"), "social").when(e.rlike(rf"^{_CARD}$"), F.when(luhn(digits) == 0, "card"))
            .when(e.rlike(rf"^{_KEY}$") | e.rlike(rf"^(?i:{_SECRET})"), "secret").otherwise("name"))


def units(e: Column, kind: Column) -> Column:
    """Array of (type, norm, raw, tail): an entity is the concatenation of its units' raw texts, each followed by its tail.
    A unit without type stays as it is."""
    unit = lambda t, norm, raw, tail="": F.struct((t if isinstance(t, Column) else F.lit(t)).alias("type"), norm.alias("norm"), raw.alias("raw"),
                                                  (tail if isinstance(tail, Column) else F.lit(tail)).alias("tail"))
    plain = lambda raw: unit(F.lit(None).cast("string"), F.lit(None).cast("string"), raw)
    prefix = F.when(e.rlike(f"^{_KEY}$"), F.lit("AKIA")).otherwise(F.regexp_extract(e, rf"^(?i:{_SECRET})", 0))
    value = F.substr(e, F.length(prefix) + 1)
    given = F.lit(None).cast("string")

    def token(t: Column, i: Column, n: Column) -> Column:
        g = given
        for name, names in GIVEN.items():
            g = F.when(F.lower(t).isin([x.lower() for x in names]), F.lit(name)).otherwise(g)
        bare = F.regexp_replace(t, r"\.$", "")
        is_title = (i == 0) & bare.isin(TITLES)
        return unit(F.when(is_title, F.lit(None).cast("string")).otherwise(F.coalesce(g, F.lit("surname"))), F.lower(t), t,
                    F.when(i < n - 1, F.lit(" ")).otherwise(F.lit("")))

    name = let(F.split(e, " "), lambda ts: F.transform(ts, lambda t, i: token(t, i, F.size(ts))))
    host = F.substring_index(e, "@", -1)
    return (F.when(kind == "mail", F.array(unit("mailbox", F.lower(e), F.substring_index(e, "@", 1), "@"), unit("domain", F.lower(host), host)))
            .when(kind == "secret", F.array(plain(prefix), unit(F.when(value.rlike("^[0-9a-f]+$"), "hex").otherwise("secret"), value, value)))
            .when(kind == "name", name).otherwise(F.array(unit(kind, e, e))))


def surrogate(key: str, kind: Column, norm: Column, attempt: int) -> Column:
    """The draw number `attempt` for a unit."""
    longer = F.when(kind.isin("mailbox", "domain", "surname", "secret", "hex"), F.lit("a" * max(0, attempt - LONGER + 1))).otherwise("")
    ending = F.when(kind == "surname", F.regexp_extract(norm, ENDINGS, 0)).when(kind == "domain", F.regexp_extract(norm, r"\.[^.]*$", 0)).otherwise("")
    head = (F.when(kind == "phone", F.regexp_extract(norm, r"^\+\d{1,3}", 0)).when(kind == "card", F.substr(norm, F.lit(1), F.lit(1))).otherwise(""))
    body = F.when(kind == "mailbox", F.substring_index(norm, "@", 1)).otherwise(
        F.substr(norm, F.length(head) + 1, F.length(norm) - F.length(head) - F.length(ending)))
    body = F.concat(body, longer)
    stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(norm) / 32 + 1).cast("int")), lambda b: F.sha2(
        F.concat_ws("/", F.lit(key), kind, norm, F.lit(str(attempt)), b.cast("string")), 256)), "")

    def made(hexes: Column) -> Column:
        byte = lambda i: F.conv(F.substr(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        from_line = lambda line, i: F.substr(F.lit(line), byte(i) % len(line) + 1, F.lit(1))

        def char(c: Column, i: Column) -> Column:
            out = c
            for line in reversed(ALPHABETS):
                out = F.when(F.instr(F.lit(line), c) > 0, from_line(line, i)).otherwise(out)
            out = F.when((i == 0) & c.between("1", "9"), from_line("123456789", i)).otherwise(out)
            return F.when(kind == "hex", from_line("0123456789abcdef", i)).otherwise(out)

        octet = lambda o, i: F.when(F.length(o) == 1, 1 + byte(i) % 9).when(F.length(o) == 2, 10 + byte(i) % 90).otherwise(100 + byte(i) % 156)
        ip = F.array_join(F.transform(F.split(norm, r"\."), lambda o, i: octet(o, i).cast("string")), ".")
        chars = F.array_join(F.transform(F.split(body, ""), char), "")
        return F.when(kind == "ip", ip).otherwise(F.concat(head, F.when(F.length(body) > 0, chars).otherwise(""), ending))

    drawn = let(stream, made)
    # a card's last digit makes the Luhn sum zero; as the last digit counts once, it takes what the others lack
    checked = let(drawn, lambda s: F.concat(F.substr(s, F.lit(1), F.length(s) - 1), F.pmod(
        -luhn(F.concat(F.regexp_replace(F.substr(s, F.lit(1), F.length(s) - 1), r"\D", ""), F.lit("0"))), F.lit(10)).cast("string")))
    return F.when(kind == "card", checked).otherwise(drawn)


def _permuted(key: str, kind: Column, norm: Column) -> Column:
    """A given name's successor in its list, some keyed number of places on."""
    out = F.lit(None).cast("string")
    for name, names in GIVEN.items():
        shift = F.pmod(F.xxhash64(F.lit(key), F.lit(name)), F.lit(len(names) - 1)).cast("int") + 1
        line = F.array(*[F.lit(x.lower()) for x in names])
        out = F.when(kind == name, F.element_at(line, (F.array_position(line, norm).cast("int") - 1 + shift) % len(names) + 1)).otherwise(out)
    return out


def dictionary(real: DataFrame, key: str) -> DataFrame:
    """type, norm, surrogate for distinct units (type, norm). Surrogates of a type are distinct.

    Raises if a format has too few values for its units."""
    real = kept(real.select("type", "norm").distinct(), "pii-units")
    listed = F.col("type").isin(list(GIVEN))
    done = real.where(listed).withColumn("surrogate", _permuted(key, F.col("type"), F.col("norm")))
    pending, attempt = real.where(~listed), 0
    parts = [done]
    while pending.take(1):
        if attempt == MOST:
            raise ValueError("a type of entity has more members than its format has values")
        drawn = pending.withColumn("surrogate", surrogate(key, F.col("type"), F.col("norm"), attempt)).where("surrogate <> norm")
        best = drawn.groupBy("type", "surrogate").agg(F.min("norm").alias("norm"))
        for taken in [real.select("type", F.col("norm").alias("surrogate"))] * (attempt < REAL) + parts[1:]:
            best = best.join(taken.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        won = cut_lineage(best.select("type", "norm", "surrogate"))
        parts.append(won)
        pending = cut_lineage(pending.join(won, ["type", "norm"], "left_anti"))
        attempt += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def replacements(entities: DataFrame, key: str) -> DataFrame:
    """entity, kind, replacement and names for the distinct entities in column `entity`. names has each part of a person's
    name and its surrogate, capitalised and in capitals, for mentions of the person by that part alone."""
    known = kept(entities.select("entity").distinct().withColumn("kind", entity_type(F.col("entity"))).where("kind IS NOT NULL"), "pii-entities")
    parts = known.select("entity", "kind", F.posexplode(units(F.col("entity"), F.col("kind"))).alias("at", "u")).select("entity", "kind", "at", "u.*")
    book = dictionary(parts.where("type IS NOT NULL"), key)
    new = F.when((F.col("raw") == F.upper("raw")) & (F.lower("raw") != F.col("raw")) & ~F.col("type").isin("secret", "hex"), F.upper("surrogate")).when(
        F.col("type").startswith("given") | (F.col("type") == "surname"),
        F.when(F.substring("raw", 1, 1) == F.upper(F.substring("raw", 1, 1)), F.initcap("surrogate")).otherwise(F.col("surrogate"))).otherwise(F.col("surrogate"))
    done = parts.join(book, ["type", "norm"], "left").withColumn("out", F.concat(F.coalesce(new, F.col("raw")), "tail"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "out"))), lambda x: x["out"]), "")
    person = F.col("type").startswith("given") | ((F.col("type") == "surname") & (F.length("norm") >= 3))
    forms = F.flatten(F.collect_list(F.when(person, F.array(*[F.struct(f("norm").alias("raw"), f("surrogate").alias("out")) for f in (F.initcap, F.upper)]))))
    return done.groupBy("entity", "kind").agg(whole.alias("replacement"), forms.alias("names"))


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """The documents with `text` rewritten and n_entities added; all else in a text stays, byte for byte.

    In a text that names a person, later mentions by a part of the name alone are rewritten too.
    Null texts stay null. The entities of equal texts are looked up once. A text so long that it holds many entities keeps them in one map
    of its own. Columns named n_entities are replaced."""
    base = docs.drop("n_entities")
    mark = F.xxhash64("text")
    found = base.select(mark.alias("mark"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))).alias("entity"))
    found = kept(found.distinct(), "pii-found")
    book = replacements(found, key)
    told = kept(found.join(book, "entity"), "pii-told")
    # two names may share a form in capitals: where a form would stand for two surrogates, it is left out
    forms = told.select("mark", F.explode("names").alias("f")).groupBy("mark", F.col("f.raw").alias("raw")).agg(F.min("f.out").alias("out"), F.max("f.out").alias("other"))
    forms = forms.where(F.col("out") == F.col("other")).groupBy("mark").agg(F.map_from_entries(F.collect_list(F.struct("raw", "out"))).alias("__names"))
    maps = told.groupBy("mark").agg(F.map_from_entries(F.collect_list(F.struct("entity", "replacement"))).alias("__book")).join(forms, "mark", "left")
    maps = maps.withColumn("__names", F.coalesce("__names", F.create_map().cast("map<string,string>")))
    # as a table of its own, so that Spark may split the rows of a text that has very many copies; it grows with
    # the corpus and is dealt at every size
    maps = kept(maps.withColumnRenamed("mark", "__mark"), "pii-maps")
    joined = base.withColumn("__mark", mark).join(maps.hint("merge"), "__mark", "left")

    def rewritten(entities: Column) -> Column:
        pieces = F.split("text", ENTITY, -1)
        told = lambda e: F.coalesce(F.col("__book")[e], e, F.lit(""))
        by_part = lambda p: F.array_join(F.transform(F.split(p, _WORD_EDGE), lambda t: F.coalesce(F.col("__names")[t], t)), "")
        between = lambda p: F.when(F.size("__names") > 0, by_part(p)).otherwise(p)
        text = F.array_join(F.transform(pieces, lambda p, i: F.concat(between(p), told(F.get(entities, i)))), "")
        n = F.size(F.filter(entities, lambda e: F.map_contains_key("__book", e))).cast("long")
        return F.struct(text.alias("text"), n.alias("n"))

    done = joined.withColumn("__new", F.when(F.col("__book").isNotNull(), let(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)), rewritten)))
    cols = [F.coalesce("__new.text", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in base.columns]
    return done.select(*cols, F.coalesce("__new.n", F.lit(0)).alias("n_entities"))


def digest(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """doc_id, n_entities and the rewritten text."""
    return pseudonymised(docs.select("doc_id", "text"), key).select("doc_id", "n_entities", "text")
