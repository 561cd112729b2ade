"""Personal data replaced by surrogates, in DataFrame functions only.

One pattern finds entities: e-mail, IPv4 and IPv6 addresses, payment cards, phone and social security numbers, IBANs,
secrets, and names after a title. It runs once over a text, and marks what it finds; the marks part the text.

A surrogate comes from a keyed hash, so it is the same wherever its entity occurs, and has its form: a digit for a digit, a
letter of the same script and case for a letter, separators where they were, valid octets, valid check digits of cards and
IBANs where they were valid and wrong ones where not. A name's title stays. Its given name and its family name have
surrogates of their own, of syllables of their script; a given name gets an ending of the title's gender, a Slavic or
Greek family name keeps its own ending (so both genders of a family share a stem). After a titled name, its parts are
replaced wherever they stand as words in the same document, with or without a title.

Surrogates that meet each other or an entity of the corpus are drawn again, until all differ (name parts among all name
parts); where a form is so full that draws don't settle it, the form becomes wider. The corpus' distinct entities are
grouped by surrogate to find such collisions. What was drawn again is a small table; it becomes a literal if it has few
rows, and is joined by document if not.

Null text: empty, no entity; with_surrogates keeps it null. Null doc_id: passed through. Repeated rows: equal results.
Overlapping candidates: the leftmost, then the first kind in the list. Very long texts: whole. Empty table: no rows. A word
that is also a name of the same document is taken for the name. Names without any title in their document stay.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import discard, stored

# Titles of men, of women and of both before names, in the languages handled.
MALE = "Mr|Herr|Herrn|Monsieur|Señor|Sr|Signor|господин|Господин|κύριος|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Mlle|Señora|Señorita|Sra|Srta|Signora|госпожа|Госпожа|κυρία|Κυρία"
BOTH = "Dr|Prof|Professor|Mx"
TITLE = f"{MALE}|{FEMALE}|{BOTH}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
HEX = r"[0-9A-Fa-f]{1,4}"
#: A word of a name: capital and letters, or letters of a script without cases.
WORD = r"(?:(?:[OD]['’])?\p{Lu}[\p{L}\p{M}\-]+|\p{Lo}[\p{Lo}\p{M}]*)"

#: Kind and pattern, in order of preference.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,24}",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{TITLE})\.?[ ]{WORD}(?:[ ]{WORD})?",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d)(?!\.\d)",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]*\d)(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}}|(?:{HEX}:){{2,7}}:)(?![\p{{L}}\p{{N}}:])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\)[ ]?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)",
    "secret": r"(?<![\p{L}\p{N}])(?:(?=[0-9A-Fa-f]*[A-Fa-f])(?=[A-Fa-f]*\d)[0-9A-Fa-f]{32,128}|AKIA[0-9A-Z]{16}|(?:ghp|gho|ghs|sk|pk|rk|xox[abps])[_\-][A-Za-z0-9_\-]{16,})(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\d])\d(?:[ \-]?\d){12,18}(?![\p{L}\d])",
}
ENTITY = "|".join(KINDS.values())
#: No entity is in a text without a match of this. Most places fail at the first character.
FIRST = "".join(sorted({t[0] for t in TITLE.split("|")} | {"A"}))
HINT = rf"[0-9@]|[_\-](?<=(?:gh[pos]|[spr]k|xox[abps])[_\-])|(?=[{FIRST}])(?:AKIA|(?:{TITLE})\.?[ ])"
#: Marks what was found; where a text has the character itself, it is marked otherwise.
MARK, FOUND, OWN = "\ue000", "\ue000#", "\ue000!"

# First and last letter of each script handled, in order of code points, and letters to draw from.
LOWER = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC, GREEK = "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
ARMENIAN = "աբգդեզթիլխծկհձղճմյնշոչպջռսվտրցփք"
SCRIPTS = {
    "ͰϿ": GREEK, "Ѐԯ": CYRILLIC, "԰֏": ARMENIAN, "את": "אבגדהוזחטיכלמנסעפצקרשת",
    "ؠي": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "ऄह": "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह",
    "กฮ": "กขคงจชซดตถทนบปผพฟมยรลวสหอ", "Ⴀჿ": "აბგდევზთიკლმნოპრსტუფქღყშჩცძწჭხჯჰ",
    "ぁゖ": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "ァヺ": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "㐀鿿": "安白宝彬斌博昌超辰成春德栋飞芳峰福刚光国海涵浩和红华慧佳建杰金晶静军俊凯康兰磊丽林玲龙梅敏明娜宁鹏平琪强青秋荣瑞善诗涛婷伟文霞祥欣雪燕阳怡英宇玉月云泽哲珍志忠",
    "가힣": "가강경고광구권규근기길김나남노다도동라류린만명모무문미민박배백범병보봉상서석선설성세소손송수숙순승시식신아안양연영예오옥용우욱원유윤은을의이인일임자장재전정조종주준지진찬창채천철최춘태하학한해현형혜호홍화환효훈희",
}
#: Consonants, vowels, and endings of given names of women, men and both, and of families, of scripts with cases.
SYLLABLES = {
    "": ("bdfgklmnprstvz", "aeiou", "a", "n", "y", "r"),
    r"\p{IsCyrillic}": ("бвгдзклмнпрст", "аеиоу", "а", "н", "и", "к"),
    r"\p{IsGreek}": ("βγδζθκλμνπρστφ", "αειου", "α", "ος", "ι", "λ"),
    r"\p{IsArmenian}": ("բգդզլկհմնպսվտր", "աեիու", "ա", "ն", "ի", "ր"),
}
#: Endings of families that stay as they are.
KEPT_ENDING = r"^\p{Lu}.+?((?:ов|ев|ёв|ин|ын)а?|(?:ск|цк)(?:ий|ая)|όπουλος|οπούλου|ίδης|ίδου|ος|ης|ας|ου)$"
#: Draws in the entity's own form; each one after them has a character more.
DRAWS = 12
#: Country codes of telephones.
COUNTRY = (
    r"1|7|2[07]|2[1-69]\d|3[0-469]|3[578]\d|4[013-9]|42\d|5[1-8]|5[09]\d|6[0-6]|6[789]\d|8[1246]|8[0578]\d|9[0-58]|9[679]\d"
)
LITERAL_ROWS = 1000


# --- keys: what a surrogate belongs to, as "kind:value" ---------------------------------------------------------------


def kind_of(entity: Column) -> Column:
    found = F.lit("card")
    for kind, pattern in reversed(list(KINDS.items())[:-1]):
        found = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(found)
    return found


def kept_ending(word: Column) -> Column:
    """The ending of a family name that stays; of Latin names none."""
    return F.when(word.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"), F.lower(F.regexp_extract(F.initcap(F.lower(word)), KEPT_ENDING, 1))).otherwise("")


def normal(word: Column) -> Column:
    return F.initcap(F.lower(word))


def name_keys(entity: Column) -> Column:
    """Of a titled name: the words that are replaced, each with its key. The last word is the family's."""
    words = F.split(entity, " ")
    title, family = F.get(words, F.lit(0)), F.element_at(words, -1)
    gender = F.when(title.rlike(rf"^(?:{FEMALE})\.?$"), "f").when(title.rlike(rf"^(?:{MALE})\.?$"), "m").otherwise("b")
    stem = F.substring(normal(family), F.lit(1), F.length(family) - F.length(kept_ending(family)))
    one = lambda word, key: F.struct(word.alias("word"), key.alias("key"))
    families = F.array(one(stem, F.concat(F.lit("family:"), stem)))
    given = normal(F.get(words, F.lit(1)))
    both = F.concat(F.array(one(given, F.concat(F.lit("given"), gender, F.lit(":"), given))), families)
    return F.when(F.size(words) > 2, both).otherwise(families)


def is_name(entity: Column) -> Column:
    return entity.rlike(f"^(?:{KINDS['name']})$")


def keys_of(entity: Column) -> Column:
    other = F.array(F.concat(kind_of(entity), F.lit(":"), entity))
    return F.when(is_name(entity), F.transform(name_keys(entity), lambda x: x["key"])).otherwise(other)


def kind_in(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def value_in(key: Column) -> Column:
    return F.substring(key, F.instr(key, ":") + 1, F.length(key))


def space_of(kind: Column) -> Column:
    """Keys of kinds of one space never share a surrogate."""
    return F.when(kind.isin("givenf", "givenm", "givenb", "family"), "name").otherwise(kind)


# --- surrogates -------------------------------------------------------------------------------------------------------


def byte_at(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, F.pmod(i, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def letter(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))


def let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_form(text: Column, stream: Column, hexadecimal: Column | bool = False) -> Column:
    """text with each letter and digit replaced by one of its class, from the stream's bytes."""
    latin = F.when(hexadecimal, "abcdef").otherwise(LOWER) if isinstance(hexadecimal, Column) else F.lit(LOWER)
    rows = [F.struct(F.lit(ends[0]).alias("a"), F.lit(ends[1]).alias("b"), F.lit(letters).alias("letters")) for ends, letters in SCRIPTS.items()]

    def drawn(c: Column, n: Column) -> Column:
        own = F.get(F.filter(F.array(*rows), lambda s: c.between(s["a"], s["b"])), F.lit(0))["letters"]
        letters = F.when(c < "À", latin).otherwise(F.coalesce(own, latin))
        one = let(letters, lambda x: F.substring(x, F.pmod(n, F.length(x)) + 1, F.lit(1)))
        return F.when(c == F.lower(c), one).otherwise(F.upper(one))

    def one(c: Column, i: Column) -> Column:
        n = byte_at(stream, i)
        digit = F.pmod(n, F.lit(10)).cast("string")
        return F.when(c.between("0", "9"), digit).when(c.rlike(r"\p{L}"), drawn(c, n)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """Of a text of digits; each second digit from the last but one to the left is doubled."""
    of = lambda c, i: F.when(i % 2 == 0, c).otherwise(2 * c - F.when(c > 4, 9).otherwise(0))
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: of(c.cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def card(entity: Column, drawn: Column, stream: Column) -> Column:
    """The check digit fits if it did."""
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    open_sum = luhn_sum(F.concat(F.regexp_replace(body, r"\D", ""), F.lit("0")))
    fitting = F.pmod(F.lit(10) - F.pmod(open_sum, F.lit(10)), F.lit(10))
    valid = F.pmod(luhn_sum(F.regexp_replace(entity, r"\D", "")), F.lit(10)) == 0
    shift = F.when(valid, 0).otherwise(1 + F.pmod(byte_at(stream, F.lit(100)), F.lit(9)))
    return F.concat(body, F.pmod(fitting + shift, F.lit(10)).cast("string"))


def rest_by_97(text: Column) -> Column:
    """Remainder of a text of digits and capitals (A is 10) as one number."""

    def add(rest: Column, c: Column) -> Column:
        step = F.when(c <= "9", rest * 10 + c.cast("int")).otherwise(rest * 100 + F.ascii(c) - 55)
        return F.pmod(step, F.lit(97)).cast("int")

    return F.aggregate(F.split(F.replace(text, F.lit(" "), F.lit("")), ""), F.lit(0), add)


def iban(entity: Column, drawn: Column, stream: Column) -> Column:
    """drawn: the country, two characters, the rest. The check digits fit if they did."""
    country, tail = F.substring(entity, 1, 2), F.substring(drawn, F.lit(5), F.length(drawn))
    fitting = 98 - rest_by_97(F.concat(tail, country, F.lit("00")))
    valid = rest_by_97(F.concat(F.substring(entity, F.lit(5), F.length(entity)), F.substring(entity, 1, 4))) == 1
    shift = F.when(valid, 0).otherwise(1 + F.pmod(byte_at(stream, F.lit(100)), F.lit(95)))
    check = 2 + F.pmod(fitting - 2 + shift, F.lit(97))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), tail)


def syllables(word: Column, stream: Column, kind: Column) -> Column:
    """A capitalised name of three syllables (four for a family) and the kind's ending, part by part of a hyphenated word."""
    short = kind != "family"

    def made(script: str, at: Column) -> Column:
        consonants, vowels, *endings = SYLLABLES[script]
        byte = lambda i: byte_at(stream, at + i)
        three = F.concat(*[x for i in range(0, 6, 2) for x in (letter(consonants, byte(i)), letter(vowels, byte(i + 1)))])
        four = F.concat(three, letter(consonants, byte(6)), letter(vowels, byte(7)))
        ending = F.when(kind == "givenf", endings[0]).when(kind == "givenm", endings[1]).when(kind == "givenb", endings[2]).otherwise(endings[3])
        return F.initcap(F.concat(F.when(short, three).otherwise(four), ending))

    def part(x: Column, i: Column) -> Column:
        out = made("", i * 16)
        for script in list(SYLLABLES)[1:]:
            out = F.when(x.rlike(script), made(script, i * 16)).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(F.initcap(F.replace(word, F.lit("-"), F.lit(" "))), " "), part), "-")


def surrogate(of: Column, key: str, draw: Column) -> Column:
    """The replacement of a "kind:value" at that draw (0 first)."""
    seed = [F.sha2(F.concat_ws("|", F.lit(key), draw.cast("string"), F.lit(str(n)), of), 256) for n in range(4)]
    whole = F.struct(F.concat(*seed).alias("stream"), kind_in(of).alias("kind"), value_in(of).alias("value"))
    return let(whole, lambda x: drawn_from(x["stream"], x["kind"], x["value"]))


def drawn_from(stream: Column, kind: Column, value: Column) -> Column:
    end = F.when(kind == "email", F.regexp_extract(value, r"\.[A-Za-z]+$", 0)).otherwise("")
    head = F.regexp_extract(value, rf"^\+(?:{COUNTRY})", 0)
    hexadecimal = (kind == "ipv6") | ((kind == "secret") & value.rlike("^[0-9A-Fa-f]+$"))
    octets = F.concat_ws(".", *[byte_at(stream, F.lit(i)).cast("string") for i in range(4)])
    # what stays before and after the part that is drawn letter by letter
    kept = F.when(kind == "phone", F.length(head)).when((kind == "secret") & ~hexadecimal, 4).when(kind == "card", 1).when(kind == "iban", 2).otherwise(0)
    inside = F.substring(value, kept + 1, F.length(value) - kept - F.length(end))
    whole = F.concat(F.substring(value, F.lit(1), kept), in_form(inside, stream, hexadecimal), end)
    cased = (space_of(kind) == "name") & value.rlike(r"\p{Lu}")
    made = F.when(cased, syllables(value, stream, kind)).when(kind == "ip", octets).otherwise(whole)
    return let(made, lambda x: F.when(kind == "iban", iban(value, x, stream)).when(kind == "card", card(value, x, stream)).otherwise(x))


def wider(of: Column, replacement: Column, key: str, draw: int) -> Column:
    """replacement with draw - DRAWS characters more: letters before an address and after a name, else digits at the end.
    Forms of addresses of machines and of cards stay: no corpus has as many as half their values."""
    stream = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"{draw}|wider|{n}"), of), 256) for n in range(4)])
    more = lambda c: in_form(c, stream)
    times, kind = draw - DRAWS, kind_in(of)
    last = F.lower(F.substring(replacement, -1, 1))
    return (
        F.when(kind == "email", F.concat(more(F.lit("x" * times)), replacement))
        .when(space_of(kind) == "name", F.concat(replacement, more(F.repeat(last, F.lit(times)))))
        .when(kind.isin("ip", "ipv6", "card"), replacement)
        .otherwise(F.concat(replacement, more(F.lit("0" * times))))
    )


# --- texts ------------------------------------------------------------------------------------------------------------


def parted(text: Column) -> Column:
    """text in parts: between entities at even places, an entity at odd ones. Own marks of the text stay marked."""
    plain = F.replace(text, F.lit(MARK), F.lit(OWN))
    marked = F.regexp_replace(plain, F.lit(f"(?:{ENTITY})"), F.lit(f"{FOUND}$0{FOUND}"))
    return F.when(text.rlike(HINT), F.split(marked, FOUND, -1)).otherwise(F.array(plain))


def entities(parts: Column) -> Column:
    """The entities of a text in parts, in order."""
    return F.filter(parts, lambda x, i: i % 2 == 1)


def known_keys(docs: DataFrame) -> DataFrame:
    """key, space, value of all that gets a surrogate, once each."""
    found = docs.select(entities(parted(F.col("text"))).alias("found")).where(F.size("found") > 0)
    each = found.select(F.explode(F.array_distinct("found")).alias("entity")).distinct()
    keys = each.select(F.explode(keys_of(F.col("entity"))).alias("key")).distinct()
    return keys.select("key", space_of(kind_in(F.col("key"))).alias("space"), value_in(F.col("key")).alias("value"))


def redrawn(docs: DataFrame, key: str) -> DataFrame:
    """key, replacement, draw of those whose first surrogate collides: with another one's, or with an entity."""
    known = stored(known_keys(docs), "entities")
    first = surrogate(F.col("key"), key, F.lit(0))
    given = stored(known.select("key", "space", first.alias("replacement"), F.lit(0).alias("draw")), "surrogates")
    values = known.select("space", F.col("value").alias("replacement")).distinct()
    for draw in itertools.count(1):
        # who keeps a shared surrogate: the one that has had it longest
        owner = F.min(F.struct("draw", "key")).alias("owner")
        owners = given.groupBy("space", "replacement").agg(F.count("*").alias("n"), owner).where("n > 1")
        shared = given.join(owners, ["space", "replacement"]).where("key <> owner.key").select("key", "space")
        taken = given.join(values, ["space", "replacement"], "left_semi").select("key", "space")
        again = stored(shared.unionByName(taken).distinct(), "collisions")
        if again.isEmpty():
            discard(again, known)
            return given.where("draw > 0")
        new = surrogate(F.col("key"), key, F.lit(draw))
        new = new if draw <= DRAWS else wider(F.col("key"), new, key, draw)
        fresh = again.select("key", "space", new.alias("replacement"), F.lit(draw).alias("draw"))
        before, given = given, stored(given.join(again, "key", "left_anti").unionByName(fresh), "surrogates")
        discard(before, again)


def new_of(own: Column | None, key: str):
    """Of a "kind:value" its replacement; own: a map of replacements that go before the first surrogates."""

    def new(of: Column) -> Column:
        first = surrogate(of, key, F.lit(0))
        return first if own is None else F.coalesce(F.try_element_at(own, of), first)

    return new


def named(parts: Column, new) -> Column:
    """Words of the document's titled names, each with its key and its replacement."""
    words = F.array_distinct(F.flatten(F.transform(F.filter(entities(parts), is_name), name_keys)))
    return F.transform(words, lambda x: F.struct(x["word"].alias("word"), x["key"].alias("key"), new(x["key"]).alias("new")))


def in_case(like: Column, x: Column) -> Column:
    """x in capitals if like is."""
    capitals = (F.length(like) > 1) & (like == F.upper(like)) & (like != F.lower(like))
    return let(x, lambda y: F.when(capitals, F.upper(y)).otherwise(y))


def replaced(parts: Column, names: Column, new) -> Column:
    """A text in parts, put together with its entities and the later mentions of its names replaced."""
    found = lambda field, value: F.get(F.filter(names, lambda p: p[field] == value), F.lit(0))["new"]

    def name(entity: Column) -> Column:
        words = F.split(entity, " ")
        family, keys = F.element_at(words, -1), F.transform(name_keys(entity), lambda x: found("key", x["key"]))
        given = lambda news: F.when(F.size(news) > 1, in_case(F.get(words, F.lit(1)), F.get(news, F.lit(0))))
        last = lambda news: in_case(family, F.concat(F.element_at(news, -1), kept_ending(family)))
        return let(keys, lambda news: F.concat_ws(" ", F.get(words, F.lit(0)), given(news), last(news)))

    def entity(x: Column) -> Column:
        return F.when(is_name(x), name(x)).otherwise(new(F.concat(kind_of(x), F.lit(":"), x)))

    def mention(w: Column) -> Column:
        stem = lambda ending: F.substring(normal(w), F.lit(1), F.length(w) - F.length(ending))
        by_stem = let(kept_ending(w), lambda ending: F.concat(found("word", stem(ending)), ending))
        return in_case(w, F.coalesce(found("word", normal(w)), by_stem, w))

    def mentions(x: Column) -> Column:
        marked = F.regexp_replace(x, F.lit(rf"(?<![\p{{L}}\p{{N}}]){WORD}(?![\p{{L}}\p{{N}}])"), F.lit(f"{FOUND}$0{FOUND}"))
        return F.array_join(F.transform(F.split(marked, FOUND, -1), lambda w, i: F.when(i % 2 == 1, mention(w)).otherwise(w)), "")

    def part(x: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, entity(x)).when(F.size(names) > 0, mentions(x)).otherwise(x)

    return F.replace(F.array_join(F.transform(parts, part), ""), F.lit(OWN), F.lit(MARK))


def with_surrogates(docs: DataFrame, key: str = "corpus", counted: bool = False) -> DataFrame:
    """docs, all columns, with text rewritten (a null one stays null), and n_entities if counted. The key decides the
    surrogates; keep it secret."""
    again = stored(redrawn(docs, key).select("key", "replacement"), "redrawn")
    n = again.count()
    # names that no column of docs has
    at, own, parts, names = "__pii_doc", "__pii_own", "__pii_parts", "__pii_names"
    more = [F.floor(F.size(parts) / 2).cast("long").alias("n_entities")] if counted else []
    split = docs.withColumn(parts, parted(F.col("text")))
    if n <= LITERAL_ROWS:
        pairs = again.collect()
        new = new_of(F.create_map(*[F.lit(x) for r in pairs for x in (r["key"], r["replacement"])]) if pairs else None, key)
    else:
        keys = F.explode(F.array_distinct(F.flatten(F.transform(entities(F.col(parts)), keys_of)))).alias("key")
        hits = split.select(F.col("doc_id").alias(at), keys).join(again, "key")
        maps = hits.groupBy(at).agg(F.map_from_entries(F.collect_set(F.struct("key", "replacement"))).alias(own))
        split = split.join(maps, F.col("doc_id").eqNullSafe(F.col(at)), "left")
        new = new_of(F.col(own), key)
    split = split.withColumn(names, named(F.col(parts), new))
    text = F.when(F.size(parts) > 1, replaced(F.col(parts), F.col(names), new)).otherwise(F.col("text")).alias("text")
    return split.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns], *more)


def surrogates(docs: DataFrame, key: str = "corpus") -> DataFrame:
    """doc_id, text with surrogates, n_entities."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_surrogates(own, key, counted=True)
