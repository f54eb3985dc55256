"""Personal data: surrogate generation with DataFrame functions only.

Entities are found by one expression per text.  Each gets a surrogate by a keyed
permutation of its own format: digits stay digits, letters stay letters of the same
script and case, separators, lengths, octet ranges, prefixes of tokens and check digits of
cards and bank accounts stay valid, given names change to names of the same gender and
script.  A permutation maps
different entities of a format to different surrogates, and the same entity always to
the same one, in every document (coreference).  The distinct entities of all documents
are then checked: an entity whose surrogate is another entity of the corpus, or is taken
already, draws again with the next key round until its surrogate is free.  The few that
drew again come to their documents by a join.

Who has the key can undo the permutations, so none is kept here: callers give one, or the
session has ``spark.scorewright.pii.key``, or one is drawn for the run.
"""

from __future__ import annotations

import secrets
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.graph import BROADCAST_ROWS, lookup
from scorewright.llm.textops import empty_text, written

KEY_SETTING = "spark.scorewright.pii.key"
#: Rounds in which an entity draws in its own format; then it takes a wider one, which grows until it is free.
FORM_ROUNDS = 6


@lru_cache(maxsize=1)
def _drawn_key() -> str:
    return secrets.token_hex(32)


def key_of(docs: DataFrame, key: str | None) -> str:
    """The key given, else the session's, else one drawn once for this run of the driver."""
    return key or docs.sparkSession.conf.get(KEY_SETTING, None) or _drawn_key()


# Given names by script and gender; a name is replaced by another of its list.
GIVEN = {
    "latin-f": "Agnieszka Aisha Alice Amina Ana Ananya Anita Anna Barbara Beatriz Camille Carmen Chloé Claire Deepa Elena Emma Eva Fatima Hannah Helen Ines Ingrid Isabel Jane Julia Karen Katarzyna Lakshmi Laura Leila Linda Lucia Léa Maria Marie Martha Mary María Mei Neha Nina Noor Olivia Paula Priya Rosa Sakura Sarah Sofia Susan Teresa Yuki Zeynep Zoë".split(),
    "latin-m": "Adam Ahmed Albert Ali Amir Andrzej Arjun Björn Carlos Charles Daniel David Diego Edward Felix François Frank George Hans Henry Hiroshi James Jean John Jorge Jose José Juan Jürgen Karl Kenji Louis Luis Mark Martin Michael Mohammed Omar Pablo Paul Peter Pierre Rahul Raj Ravi Robert Søren Thomas Wei Yusuf".split(),
    "cyrillic-f": "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    "cyrillic-m": "Алексей Андрей Борис Дмитрий Иван Михаил Николай Сергей".split(),
    "greek-f": "Αγγελική Βασιλική Ελένη Κατερίνα Μαρία Σοφία".split(),
    "greek-m": "Αλέξανδρος Γιάννης Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης".split(),
}
#: Titles after which a capitalised word is a name.
TITLES = "Mrs|Mr|Ms|Miss|Dr|Prof|Mme|Herr|Frau|Señora|Señor|Sra|Sr"
#: Titles that follow a Chinese name.
HAN_TITLES = "先生|女士|小姐|博士|教授"

# Alphabets inside which a character is replaced.  No character is in two of them.
HAN_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗郑梁谢宋唐许邓冯韩曹曾彭萧蔡潘田董袁于余叶蒋杜苏魏程吕丁沈任姚卢傅钟姜崔谭廖范汪陆金石戴贾韦夏邱方侯邹熊孟秦白江阎薛尹段雷黎史龙陶贺顾毛郝龚邵万钱严武戚莫孔向汤"
HAN_GIVEN = "伟芳娜秀英敏静丽强磊军洋勇艳杰娟涛明超兰霞平刚桂华玉红玲芬燕辉建国志文小晓梅春雪飞鹏俊峰波宇浩凯健斌琳欣怡佳慧婷雅倩楠晨阳子轩博"
ALPHABETS = (
    "0123456789",
    "bcdfghjklmnpqrstvwxz",
    "aeiouy",
    "BCDFGHJKLMNPQRSTVWXZ",
    "AEIOUY",
    "бвгджзклмнпрстфхцчшщ",
    "аеёиоуыэюя",
    "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
    "АЕЁИОУЫЭЮЯ",
    "ћђљњџґ",
    "ЋЂЉЊЏҐ",
    "іїє",
    "ІЇЄ",
    "йьъ",
    "ЙЬЪ",
    "βγδζθκλμνξπρστφχψ",
    "αεηιουωάέήίόύώϊϋΐΰ",
    "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
    "ΑΕΗΙΟΥΩΆΈΉΊΌΎΏΪΫ",
    "çñßšžčćđłńśźżğşþðŵĉĝĥĵŝţțșřťďľĺňŕķģļņħŋ",
    "äëïöüáéíóúàèìòùâêîôûåæøœãõýÿāēīōūąęėįųıůőűěŷŭǎ",
    "ÇÑŠŽČĆĐŁŃŚŹŻĞŞÞÐŴĈĜĤĴŜŢȚȘŘŤĎĽĹŇŔĶĢĻŅĦŊ",
    "ÄËÏÖÜÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÅÆØŒÃÕÝŸĀĒĪŌŪĄĘĖĮŲİŮŐŰĚŶŬǍ",
    HAN_SURNAMES,
    HAN_GIVEN,
)
#: Other scripts, by first and last code point of their letters; a letter is replaced within its range.
RANGES = (("ぁ", "ゖ"), ("ァ", "ヺ"), ("가", "힣"), ("ا", "غ"), ("ف", "ي"), ("א", "ת"), ("अ", "ह"), ("ก", "ฮ"), ("ა", "ჰ"), ("ա", "ֆ"), ("Ա", "Ֆ"), ("一", "龥"))
HEX_LOWER, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"
#: Letters that no alphabet or range has: a name or an email that holds one is replaced whole.
UNKNOWN = r"[\p{L}&&[^ς" + "".join(ALPHABETS) + "".join(f"{a}-{b}" for a, b in RANGES) + "]]"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_H = "[0-9A-Fa-f]{1,4}"
#: What a token of a known kind begins with; its surrogate keeps it.
TOKEN = r"(?:(?:sk|pk|rk)[-_](?:live[-_]|test[-_])?|gh[opsur]_|xox[bp]-|AKIA|(?:sk|pk|ghp|gho))"
#: Kinds in the order in which they are tried at a place.  Lookbehinds keep the search linear in long runs.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}"
    r"|(?:(?:sk|pk|rk)[-_](?:live[-_]|test[-_])?|gh[opsur]_|xox[bp]-)[A-Za-z0-9]{16,64}"
    r"|(?=[A-Za-z]{0,64}[0-9])(?:sk|pk|ghp|gho)[A-Za-z0-9]{16,64}|AKIA[-_]?[A-Za-z0-9]{16,64})(?![A-Za-z0-9])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip6": rf"(?=[0-9A-Fa-f]{{1,4}}:)(?<![\w:.])(?=[A-Fa-f:]{{0,30}}[0-9])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}})(?![\w:])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "phone": r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}"
    r"|(?:\+\d{1,3}[ .-]?(?:\(0\))?\d|0\d)(?:[ .-]\d{2}){4}|\+\d{1,3}(?:[ .-]\d{2,8}){2,4}|\+\d{8,15})(?![\w-])",
}
#: A capitalised word, with inner apostrophes, hyphens and capitals (O'Brien, Smith-Jones, McDonald), without a possessive s.
_NAME = r"\p{Lu}(?:['’](?=\p{Lu}))?(?:\p{Lu}(?=\p{Ll}))?[\p{Ll}\p{M}]++(?:(?:['’](?!s\b)|-)\p{Lu}?[\p{Ll}\p{M}]++|\p{Lu}[\p{Ll}\p{M}]++)*+"
_HAN = "[一-龥]"
_HAN_NAME = rf"(?={_HAN}{{2}})(?<!{_HAN})[{HAN_SURNAMES}](?:{_HAN}{{1,2}}(?={HAN_TITLES})|{_HAN}{{2}}(?!{_HAN}))"
PATTERNS["name"] = (
    rf"(?=\p{{Lu}})(?<=\b(?:{TITLES})\.? )(?:\p{{Lu}}\. ?){{0,3}}(?:{_NAME} ){{0,2}}{_NAME}"
    + r"|(?=\p{Lu})(?<!\p{L})(?:" + "|".join(n for names in GIVEN.values() for n in names) + rf")(?= ) (?:\p{{Lu}}\. ?){{0,2}}{_NAME}"
    + f"|{_HAN_NAME}"
)
#: All kinds but names; places where none can begin are passed over at once.
STRUCTURED = (
    "|".join(f"(?:{PATTERNS[k]})" for k in ("email", "secret", "iban", "ip6"))
    + "|(?=[0-9+(])(?:"
    + "|".join(f"(?:{PATTERNS[k]})" for k in ("ssn", "card", "ip", "phone"))
    + ")"
)
ENTITY = f"{STRUCTURED}|(?:{PATTERNS['name']})"
#: What every entity but a name holds: a digit, an at sign or a token's mark.
CUE = "[0-9@]"
MARKS = "sk- sk_ pk- pk_ rk- rk_ gho_ ghp_ ghs_ ghu_ ghr_ xoxb- xoxp- AKIA".split()
#: Words before a capitalised word that make it part of a name.
_BEFORE_NAME = [*TITLES.split("|"), *(n for names in GIVEN.values() for n in names)]


def _has_name(text: Column) -> Column:
    """Whether a title or a listed given name comes before a capitalised word, or a Chinese surname stands in a short word."""
    before = F.regexp_extract_all(text, F.lit(r"(\p{Lu}\p{Ll}+)\.? (?=\p{Lu})"), F.lit(1))
    listed = F.array(*map(F.lit, _BEFORE_NAME))
    latin = F.when(text.rlike(r"\p{Lu}\p{Ll}+\.? \p{Lu}"), F.arrays_overlap(before, listed)).otherwise(F.lit(False))
    return latin | text.rlike(_HAN_NAME)


def entities(text: Column) -> Column:
    """All entities of a text in order, as array<string>.

    Cheap searches come first: an entity holds a digit, an at sign or a token's beginning, or is a name.
    """
    return (
        F.when(_has_name(text), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
        .when(text.rlike(CUE) | reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in MARKS)), F.regexp_extract_all(text, F.lit(STRUCTURED), F.lit(0)))
        .otherwise(F.array().cast("array<string>"))
    )


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern the whole entity has."""
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(entity.rlike(rf"\A(?:{PATTERNS[kind]})\z"), F.lit(kind)).otherwise(out)
    return out


def _digest(key: Column, r: Column, rest: Column) -> Column:
    """What a round's draws depend on: the key, the round and the other half."""
    return F.sha2(F.concat_ws("\x1f", key, r.cast("string"), rest), 256)


def _draw(digest: Column, i: Column, n: int) -> Column:
    """A keyed pseudorandom number below n for place i."""
    return F.pmod(F.xxhash64(digest, i), F.lit(n))


def _chr(code: Column) -> Column:
    """The character of a code point below 65536."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


#: Alphabets by table: all, hexadecimal digits of one case, and of both.
TABLES = (ALPHABETS, (HEX_LOWER,), (HEX_UPPER,), ("0123456789", "abcdef", "ABCDEF"))


def _shift(char: Column, digest: Column, i: Column, every: Column, lows: Column, sizes: Column) -> Column:
    """A character moved by a draw within its alphabet, or within its script's range of letters; others stay."""

    def moved(at: Column) -> Column:
        low, size = F.get(lows, at - 1), F.get(sizes, at - 1)
        to = low + (at - 1 - low + F.pmod(F.xxhash64(digest, i), size)) % size
        out = F.when(at > 0, F.substr(every, (to + 1).cast("int"), F.lit(1)))
        lo = F.coalesce(*(F.when(char.between(a, b), F.lit(ord(a))) for a, b in RANGES))
        n = F.coalesce(*(F.when(char.between(a, b), F.lit(ord(b) - ord(a) + 1)) for a, b in RANGES))
        code = F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("long")
        out = out.when(lo.isNotNull(), _chr((lo + (code - lo + F.pmod(F.xxhash64(digest, i), n)) % n).cast("long")))
        return out.otherwise(char)

    return _let(F.instr(every, char), moved)


def permuted(value: Column, key: Column, table: Column | None = None, rounds: int = 4) -> Column:
    """A keyed permutation of the strings with ``value``'s pattern of alphabets.

    A Feistel network over characters at even and odd places: a round turns one half by
    draws from the other half, so each round can be undone.  ``table``: which of ``TABLES``, the first unless given.
    """
    table = F.lit(0) if table is None else table
    flat = ["".join(t) for t in TABLES]
    # a literal each once the optimizer has folded them
    lows = F.from_json(F.lit(str([[f.index(a) for a in t for _ in a] for f, t in zip(flat, TABLES, strict=True)])), "array<array<int>>")
    sizes = F.from_json(F.lit(str([[len(a) for a in t for _ in a] for t in TABLES])), "array<array<int>>")
    every = F.split(F.lit("\n".join(flat)), "\n")

    def run(t: Column) -> Column:
        def step(chars: Column, r: Column) -> Column:
            rest = F.array_join(F.transform(chars, lambda c, i: F.when(i % 2 == r % 2, F.lit("")).otherwise(c)), "")
            return _let(
                _digest(key, r, rest),
                lambda h: F.transform(chars, lambda c, i: F.when(i % 2 == r % 2, _shift(c, h, i, t["every"], t["lows"], t["sizes"])).otherwise(c)),
            )

        chars = F.filter(F.split(value, ""), lambda c: c != "")
        return F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), chars, step), "")

    return _let(F.struct(every[table].alias("every"), lows[table].alias("lows"), sizes[table].alias("sizes")), run)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _luhn_rest(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a digit string whose last digit is the check digit."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10


def _into(pattern: Column, digits: Column) -> Column:
    """``digits`` put in the places of ``pattern``'s digits."""
    chars = F.filter(F.split(pattern, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    done = F.aggregate(
        chars,
        start,
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.rlike(r"\d"), F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            F.when(c.rlike(r"\d"), s["at"] + 1).otherwise(s["at"]).alias("at"),
        ),
    )
    return done["out"]


def _card_check(first: Column, body: Column, value: Column) -> Column:
    """The last digit for which the Luhn remainder stays as it was (0: valid)."""
    return F.pmod(_luhn_rest(_digits(value)) - _luhn_rest(F.concat(first, body, F.lit("0"))), F.lit(10)).cast("string")


def _ip(value: Column, key: Column) -> Column:
    """A Feistel network over the octets, each modulo 256."""
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("long"))

    def step(o: Column, r: Column) -> Column:
        rest = F.array_join(F.transform(o, lambda x, i: F.when(i % 2 == r % 2, F.lit("")).otherwise(x.cast("string"))), ".")
        return F.transform(
            F.arrays_zip(o.alias("c"), F.array_repeat(_digest(key, r, rest), F.size(o)).alias("h")),
            lambda x, i: F.when(i % 2 == r % 2, (x["c"] + _draw(x["h"], i, 256)) % 256).otherwise(x["c"]),
        )

    return F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(3)), octets, step).cast("array<string>"), ".")


def _mod97(chars: Column) -> Column:
    """The remainder modulo 97 of a string of digits and capitals, a capital being two digits."""
    values = F.filter(F.split(chars, ""), lambda c: c != "")

    def step(r: Column, c: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return (r * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(values, F.lit(0), step)


def _iban_check(country: Column, old: Column, body: Column, new: Column) -> Column:
    """Check digits of account ``new`` that are as far from the right ones as ``old`` were with ``body`` (0: valid)."""
    right = F.transform(F.array(body, new), lambda x: 98 - _mod97(F.concat(F.replace(x, F.lit(" "), F.lit("")), country, F.lit("00"))))
    return F.lpad((F.pmod(right[1] - 2 + old.cast("int") - right[0], F.lit(97)) + 2).cast("string"), 2, "0")


def _given(given: Column, key: Column, other: Column) -> Column:
    """A listed given name turns to another of its gender and script; for the rest ``other``."""
    out = other
    for group, names in GIVEN.items():
        listed = F.split(F.lit(" ".join(names)), " ")
        turn = _draw(_digest(key, F.lit(0), F.lit(group)), F.lit(0), len(names) - 1) + 1
        at = (F.array_position(listed, given) - 1 + turn) % len(names)
        out = F.when(F.array_contains(listed, given), F.get(listed, at.cast("int"))).otherwise(out)
    return out


def _let(value: Column, use) -> Column:
    """``use`` applied to a value that is computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def surrogate(entity: Column, key: str | Column) -> Column:
    """The replacement of one entity under a key.

    What stays: a phone's country code, a bank account's country, a token's mark, a card's first digit,
    an email's top-level domain.  Parts that are permuted apart: the words of a name, and an email's
    local part and domain, so one domain stays one.
    """
    key = F.lit(key) if isinstance(key, str) else key
    return _let(F.struct(kind_of(entity).alias("kind"), entity.alias("e")), lambda x: _surrogate(x["kind"], x["e"], key))


def _surrogate(kind: Column, e: Column, key: Column) -> Column:
    is_hex = kind.isin("secret", "ip6")
    upper, lower = F.when(is_hex, ~e.rlike("[a-z]")), F.when(is_hex, ~e.rlike("[A-Z]"))
    plain_hex = (kind == "ip6") | e.rlike(r"\A(?:[0-9a-f]+|[0-9A-F]+)\z")
    table = F.when(~is_hex | ~plain_hex, 0).when(lower, 1).when(upper, 2).otherwise(3)
    stays = (
        F.when(kind == "secret", F.when(plain_hex, "").otherwise(F.regexp_extract(e, rf"\A{TOKEN}", 0)))
        .when(kind == "phone", F.regexp_extract(e, r"^\+\d{1,3}(?=[ .-])", 0))
        .when(kind == "iban", F.substr(e, F.lit(1), F.lit(4)))
        .otherwise("")
    )
    top = F.concat(F.lit("."), F.substring_index(e, ".", -1))
    domain = F.substring_index(e, "@", -1)
    parts = (
        F.when(kind == "name", F.split(e, " "))
        .when(kind == "email", F.array(F.substring_index(e, "@", 1), F.substr(domain, F.lit(1), F.length(domain) - F.length(top))))
        .when(kind == "card", F.array(F.substr(_digits(e), F.lit(2), F.length(_digits(e)) - 2)))
        .otherwise(F.array(F.substr(e, F.length(stays) + 1, F.length(e))))
    )
    under = F.concat(key, F.lit("/"), kind)

    def build(x: Column) -> Column:
        made = F.transform(x["parts"], lambda p, i: permuted(p, F.concat(under, F.when((kind == "email") & (i == 1), "/domain").otherwise("")), x["table"]))

        def joined(m: Column) -> Column:
            name = F.array_join(F.concat(F.array(_given(x["parts"][0], under, m[0])), F.slice(m, 2, F.size(m))), " ")
            whole = F.initcap(_word(F.concat(key, F.lit("/whole")), e))
            first = F.substr(_digits(e), F.lit(1), F.lit(1))
            country, old = F.substr(e, F.lit(1), F.lit(2)), F.substr(e, F.lit(3), F.lit(2))
            return (
                F.when(kind == "name", F.when(e.rlike(UNKNOWN), whole).otherwise(name))
                .when(kind == "email", F.concat(m[0], F.lit("@"), m[1], top))
                .when(kind == "card", _into(e, F.concat(first, m[0], _card_check(first, m[0], e))))
                .when(kind == "ip", _ip(e, under))
                .when(kind == "iban", F.concat(country, _iban_check(country, old, x["parts"][0], m[0]), m[0]))
                .otherwise(F.concat(x["stays"], m[0]))
            )

        return _let(made, joined)

    return _let(F.struct(parts.alias("parts"), stays.alias("stays"), table.alias("table")), build)


def _word(key: Column, value: Column) -> Column:
    """Twelve drawn letters."""

    def letters(d: Column) -> Column:
        def letter(i: int) -> Column:
            of = "aeiou" if i % 2 else "bcdfghjklmnpqrstvwxz"
            return F.substr(F.lit(of), (_draw(d, F.lit(i), len(of)) + 1).cast("int"), F.lit(1))

        return F.concat(*map(letter, range(12)))

    return _let(_digest(key, F.lit(0), value), letters)


def _digits_of(key: Column, value: Column, n: Column) -> Column:
    """``n`` drawn digits."""
    return _let(_digest(key, F.lit(0), value), lambda d: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _draw(d, i, 10).cast("string")), ""))


def _wide(entity: Column, key: Column, more: Column) -> Column:
    """A wider form of an entity whose own format has no free surrogate, with ``more`` further digits.

    Names and emails get drawn letters, an address in digits one in hexadecimal, whose space is as good as endless,
    the others further digits behind their surrogate: phones and numbers another group, tokens and accounts a longer tail.
    """
    word, kind = _word(F.concat(key, F.lit("/wide")), entity), kind_of(entity)
    digits = _digits_of(F.concat(key, F.lit("/wide/digits")), entity, more)
    mail = F.concat(word, F.lit("@"), _word(F.concat(key, F.lit("/wide/domain")), entity), F.lit(".com"))
    eight = F.sha2(F.concat_ws("\x1f", key, F.lit("wide/ip"), entity), 256)
    address = F.concat(F.lit("2001:db8"), *(F.concat(F.lit(":"), F.substring(eight, 1 + 4 * i, 4)) for i in range(6)))
    tail = F.concat(surrogate(entity, key), F.when(kind.isin("phone", "ssn", "card"), F.lit("-")).otherwise(F.lit("")), digits)
    return (
        F.when(kind == "name", F.initcap(word))
        .when(kind == "email", mail)
        .when(kind.isin("ip", "ip6"), address)
        .otherwise(tail)
    )


def exceptions(docs: DataFrame, key: str) -> DataFrame | None:
    """Entities whose surrogate of round 0 is not free, with one that is: entity, surrogate; None if there are none.

    In each round the entities that are left draw a surrogate.  It is theirs unless it is
    an entity of the corpus or was given before; of several entities that draw one, the
    smallest takes it.  So no two entities share a surrogate and none is a real entity.  Rounds go on until
    every entity has one: wider forms hold one more digit each round, so they do not run out.
    """
    spark = docs.sparkSession
    found = written(docs.select(F.explode(entities(empty_text())).alias("entity")).distinct(), "entities")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left, given, again = found.repartition(parts, "entity"), None, None
    round_key = F.concat(F.lit(f"{key}/"), F.col("_round"))
    form = surrogate(F.col("entity"), round_key)
    wide = _wide(F.col("entity"), round_key, F.greatest(F.lit(4), F.col("_round").cast("int")))
    r = -1
    while True:
        r += 1
        rows = left.withColumn("_round", F.lit(str(r)))
        made = written(rows.select("entity", (form if r < FORM_ROUNDS else wide).alias("surrogate")), "surrogates")
        taken = found.select(F.col("entity").alias("surrogate"))
        taken = taken if given is None else taken.union(given.select("surrogate"))
        free = made.join(taken, "surrogate", "left_anti").groupBy("surrogate").agg(F.min("entity").alias("entity"))
        got = written(free.select("entity", "surrogate"), "given")
        given = got if given is None else given.union(got)
        if r:
            again = got if again is None else again.union(got)
        left = written(made.join(got, "entity", "left_anti").select("entity"), "left")
        if left.isEmpty():
            return again


def _replacing(docs: DataFrame, key: str | None) -> tuple[DataFrame, Column]:
    """``docs`` with column ``_found`` and what the entities of ``_found`` become.

    What an entity that drew again becomes is the same in texts with the same entities,
    so texts find it by these.
    """
    key, found = key_of(docs, key), entities(F.col("text"))
    with_found, again = docs.withColumn("_found", found), exceptions(docs, key)
    if again is None:
        return with_found, F.transform("_found", lambda e: surrogate(e, f"{key}/0"))
    again = written(again.select(F.col("entity").alias("_entity"), "surrogate"), "again")
    few = again.count() <= BROADCAST_ROWS
    lists = docs.select(found.alias("_key")).where(F.size("_key") > 0).distinct()
    per_list = lists.select("_key", F.explode(F.array_distinct("_key")).alias("_entity")).join(F.broadcast(again) if few else again, "_entity")
    per_list = per_list.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_entity", "surrogate"))).alias("_again"))
    per_list = written(per_list, "lists")
    held = per_list.agg(F.coalesce(F.sum(F.size("_key")), F.lit(0))).first()[0]  # entities of all these lists
    # a list that many texts have is dealt over salts, or comes to all by broadcast; texts without entities match nothing
    spread = F.array(F.concat(F.lit("\0"), F.xxhash64("doc_id", "text").cast("string")))
    keyed = with_found.withColumn("_key", F.when(F.size("_found") > 0, F.col("_found")).otherwise(spread)).withColumn("_by", F.xxhash64("doc_id", "text"))
    met = lookup(keyed, per_list, held, "_key", "_by", "left").drop("_by")
    return met, F.transform("_found", lambda e: F.coalesce(F.try_element_at(F.col("_again"), e), surrogate(e, f"{key}/0")))


def _joined(text: Column, made: Column) -> Column:
    """The text with its entities, in order, replaced by ``made``."""
    parts = F.when(_has_name(text), F.split(text, ENTITY, -1)).otherwise(F.split(text, STRUCTURED, -1))
    return F.array_join(F.flatten(F.zip_with(parts, made, lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")


def with_surrogates(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with the entities in ``text`` replaced; other columns, and null texts, stay as they are.

    Repeated rows get equal surrogates; an empty table gives no rows.
    """
    met, made = _replacing(docs, key)
    changed = F.when(F.size("_found") > 0, _joined(F.col("text"), made)).otherwise(F.col("text"))
    return met.withColumn("text", changed).select(*docs.columns)


def replace_pii(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text with surrogates, n_entities and kinds (comma-joined, in order of appearance).

    A null text stays null with no entities; repeated rows give a row each; an empty
    table none; only doc_id and text are read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, made = _replacing(narrow, key)
    none = F.coalesce(F.size("_found") <= 0, F.lit(True))
    return found.select(
        "doc_id",
        F.when(none, F.col("text")).otherwise(_joined(F.col("text"), made)).alias("text"),
        F.when(none, F.lit(0)).otherwise(F.size("_found")).cast("long").alias("n_entities"),
        F.when(none, F.lit("")).otherwise(F.array_join(F.transform("_found", kind_of), ",")).alias("kinds"),
    )
