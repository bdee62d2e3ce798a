"""Personal data and secrets replaced by keyed surrogates of the same kind, shape and script.

What is found: e-mail and IP addresses, card, phone, social-security and bank-account numbers, access
keys, secrets behind a name such as ``password=``, and names of people after a title or a known given
name; a name found in a text is found wherever else the text has it with a capital.  Every entity is
brought to a plain value (digits only, lower case, one blank), which makes its mentions one entity; a
surrogate is drawn for the value by a keyed hash and written in the layout of each mention.  Given
names keep their gender and script, family names their script.

Surrogates are checked against each other and against all real values of the corpus, in rounds: of
several values with one surrogate the smallest keeps it, the others draw again.  So different
entities stay different, no surrogate is someone else's real value, and one entity has one surrogate
everywhere.  The entity table is a distributed table; documents meet it by a join.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.llm.arrow import per_row, rows_of
from punctual.llm.extraction import STOP_WORDS
from punctual.llm.prune import marked
from punctual.session import staged

#: Rounds of drawing; only a kind whose numbers are nearly all in use needs more.
MAX_ROUNDS = 100

#: Common given and family names, by gender and script.
GIVEN = {
    ("latin", "f"): """Alice Amelia Anna Barbara Carla Caroline Chloe Clara Diana Elena Emily Emma Eva Fiona Grace Hannah Helen
        Ida Ines Isabel Jane Julia Karen Laura Linda Lucy Maria Marie Martha Mary Nina Nora Olivia Paula Rachel Rosa Ruth
        Sarah Sofia Susan Teresa Vera""".split(),
    ("latin", "m"): """Adam Albert Alexander Andrew Anton Arthur Benjamin Bruno Carlos Charles Daniel David Edward Eric Felix
        Frank George Henry Hugo Ivan Jack James John Jonas Joseph Karl Leo Lucas Marco Martin Max Michael Oscar Otto Paul
        Peter Robert Samuel Simon Stefan Thomas Victor""".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Наталья Ольга Светлана".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
FAMILY = {
    "latin": """Adams Bauer Becker Bennett Bernard Carter Castro Clarke Costa Diaz Dubois Evans Fischer Foster Garcia Gomez
        Harris Hoffmann Jensen Keller Klein Lambert Lopez Martin Meyer Moreau Morgan Morris Murphy Navarro Nelson Novak
        Ortega Parker Petit Reed Richter Rivera Romero Schmidt Silva Smith Torres Turner Vogel Wagner Weber Wright""".split(),
    "cyrillic": "Волков Зайцев Иванов Козлов Кузнецов Лебедев Морозов Новиков Орлов Соколов".split(),
    "greek": "Αγγέλου Βασιλείου Γεωργίου Δημητρίου Ιωάννου Νικολάου Παππάς Σταύρου".split(),
}
#: Titles and the gender they tell (n: none).
TITLES = {
    "mr": "m", "mrs": "f", "ms": "f", "miss": "f", "sir": "m", "madam": "f", "dr": "n", "prof": "n", "herr": "m", "frau": "f",
    "monsieur": "m", "madame": "f", "mme": "f", "mlle": "f", "señor": "m", "señora": "f", "sr": "m", "sra": "f", "srta": "f",
    "signor": "m", "signora": "f", "г-н": "m", "г-жа": "f",
}
_GENDER = {name.lower(): gender for (_, gender), names in GIVEN.items() for name in names}

_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}@(?:[\w-]{1,63}\.)+[A-Za-z]{2,24}\b")
_IP4 = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
_IP6 = re.compile(r"(?<![\w:.])[\w.]*:[\w.]*:[\w:.]*")  # what may hold one
_GROUP = re.compile(r"[0-9A-Fa-f]{0,4}:")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_CARD = re.compile(r"(?<![\w.-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?![\w-])")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_PHONE = re.compile(r"(?<![\w.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w-])|(?<![\w.-])\+\d{8,15}(?!\w)")
_KEY = re.compile(r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|(?<!\w)gh[pousr]_[A-Za-z0-9]{36}(?!\w)|(?<!\w)sk[-_][A-Za-z0-9_-]{16,}")
_SECRET = re.compile(
    r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)(?P<sep>\"?\s*[=:]\s*)(?P<quote>[\"']?)(?P<value>[^\s\"',;]{6,})"
)
_TITLED = re.compile(
    r"(?<!\w)(?P<title>Mr|Mrs|Ms|Miss|Sir|Madam|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señora|Señor|Sra|Srta|Sr|Signora|Signor|[Гг]-н|[Гг]-жа)"
    r"\.?[ \t]+(?P<names>[^\W\d_a-zа-я][^\W\d_]+(?:[ \t]+[^\W\d_a-zа-я][^\W\d_]+){0,2})"
)
_CAPITALS = re.compile(
    r"(?<!\w)(?P<given>[^\W\d_a-zа-яα-ω][^\W\d_]+)(?=[ \t]+(?P<family>[^\W\d_a-zа-яα-ω][^\W\d_]+)(?!\w)"
    r"(?P<more>[ \t]+[^\W\d_a-zа-яα-ω][^\W\d_]+(?!\w))?)"
)
_NAME = re.compile(r"(?<!\w)[^\W\d_a-zа-яα-ω][^\W\d_]+(?!\w)")


def _ip6(text: str) -> tuple[int, int, str] | None:
    """Start, end and plain value of the address in a run of letters, digits, colons and points.

    A label before it (``host:2001:db8::1``) and a sign after it are left out; ``::`` alone is none.
    """
    start, end = len(text) - len(text.lstrip(".")), len(text.rstrip("."))
    while start < end and not _GROUP.match(text, start):
        start = text.find(":", start) + 1
        if not start:
            return None
    if text[start:end].endswith(":") and not text[start:end].endswith("::"):
        end -= 1
    try:
        value = _short(_groups(text[start:end]))
    except ValueError:
        return None
    return (start, end, value) if value != "::" else None


def _groups(address: str) -> list[str]:
    number = int(ipaddress.IPv6Address(address))
    return [f"{number >> at & 0xFFFF:x}" for at in range(112, -1, -16)]


def _short(groups: list[str]) -> str:
    """The groups with the longest run of zeros left out."""
    text = ":".join(groups)
    zeros = max(re.finditer(r"(?<!\w)0(?::0)+(?!\w)", text), key=lambda m: len(m[0]), default=None)
    return f"{text[: zeros.start()].rstrip(':')}::{text[zeros.end() :].lstrip(':')}" if zeros else text


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def script_of(name: str) -> str:
    for c in name:
        if c.isalpha():
            first = unicodedata.name(c, "").split(" ")[0].lower()
            return first if first in FAMILY else "other" if first != "latin" else "latin"
    return "other"


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """Entities of a whole text in order, none overlapping: (start, end, kind, plain value).

    Kinds of names tell script and gender; where mentions overlap, the one found by the more
    specific rule stays.  Numbers in card layout count only with a right check digit or as sixteen
    digits in one piece, which clean prose does not have.
    """
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []  # in order

    def add(start, end, kind, value):
        at = bisect.bisect(taken, (start, end))
        free = (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end)
        if value and free:
            taken.insert(at, (start, end))
            found.append((start, end, kind, value))

    lower = text.lower()
    if any(w in lower for w in ("passw", "pwd", "secret", "token", "key")):
        for m in _SECRET.finditer(text):
            add(m.start("value"), m.end("value"), "secret", m["value"])
    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(m.start(), m.end(), "email", m[0].lower())
    if any(w in text for w in ("AKIA", "ASIA", "gh", "sk-", "sk_")):
        for m in _KEY.finditer(text):
            add(m.start(), m.end(), "key", m[0])
    if "::" in text or text.count(":") >= 6:
        for m in _IP6.finditer(text):
            got = _ip6(m[0])
            if got:
                add(m.start() + got[0], m.start() + got[1], "ip6", got[2])
    if re.search(r"\d", text):
        for m in _IP4.finditer(text):
            add(m.start(), m.end(), "ip4", m[0])
        for m in _IBAN.finditer(text):
            add(m.start(), m.end(), "iban", m[0].replace(" ", ""))
        for m in _CARD.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if _luhn(digits) or m[0] == digits and len(digits) == 16 and digits[0] in "3456":
                add(m.start(), m.end(), "card", digits)
        for m in _SSN.finditer(text):
            add(m.start(), m.end(), "ssn", re.sub(r"\D", "", m[0]))
        for m in _PHONE.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 8 <= len(digits) <= 15:
                add(m.start(), m.end(), "phone", digits[-10:])  # with or without a country code

    def person(spans: list[tuple[int, int]], gender: str):
        given, family = spans[:-1], spans[-1]
        if not given and gender == "" and text[family[0] : family[1]].lower() in _GENDER:
            given, family = [family], None
        for s, e in given:
            name = text[s:e].lower()
            add(s, e, f"given/{script_of(name)}/{_GENDER.get(name, gender or 'n')}", name)
        if family:
            name = text[family[0] : family[1]].lower()
            add(*family, f"family/{script_of(name)}", name)

    for m in _TITLED.finditer(text):
        at = m.start("names")
        person([(at + w.start(), at + w.end()) for w in re.finditer(r"\S+", m["names"])], TITLES.get(m["title"].lower(), "n"))
    for m in _CAPITALS.finditer(text):
        if m["given"].lower() in _GENDER and m["given"].lower() != m["family"].lower():
            # of Anna Maria Smith the second is a given name too, its own pair finds the family
            middle = m["more"] and m["family"].lower() in _GENDER
            person([m.span("given")] if middle else [m.span("given"), m.span("family")], "")
    # further mentions of the names of this text; function words, found by mistake, don't spread
    names: dict[str, str] = {}
    for _, _, kind, value in sorted(found):
        if kind.startswith(("given", "family")) and value not in STOP_WORDS:
            names.setdefault(value, kind)
    if names:
        for m in _NAME.finditer(text):
            kind = names.get(m[0].lower())
            if kind and not m[0][0].islower():
                add(m.start(), m.end(), kind, m[0].lower())
    return sorted(found)


class _Stream:
    """Numbers drawn from a keyed hash of an entity."""

    def __init__(self, key: bytes, *parts):
        self.key, self.seed, self.count, self.pool = key, "\x1f".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.new(self.key, self.seed + self.count.to_bytes(4, "big"), hashlib.sha256).digest()
            self.count += 1
        value, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return value % n


def _like(c: str, draw: _Stream, hexadecimal: bool = False) -> str:
    """Another character of the same class: digit, letter of the same case and alphabet."""
    if c.isdigit():
        return str(draw.below(10))
    if hexadecimal and c in "abcdefABCDEF":
        return ("abcdef" if c.islower() else "ABCDEF")[draw.below(6)]
    if c.isascii() and c.isalpha():
        return chr((97 if c.islower() else 65) + draw.below(26))
    if c.isalpha():
        # a letter from the same stretch of 16 code points, of the same case
        near = [chr(o) for o in range(ord(c) // 16 * 16, ord(c) // 16 * 16 + 16) if chr(o).isalpha() and chr(o).islower() == c.islower()]
        return near[draw.below(len(near))]
    return c


_CONSONANTS, _VOWELS = "bcdfghklmnprstvw", "aeiou"


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """Plain surrogate of a plain value; another one for each attempt."""
    draw = _Stream(key, kind, value, attempt)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        made = "".join(_like(c, draw) for c in local)
        return f"{made}@{''.join(_like(c, draw) if c.isalnum() else c for c in host)}.{top}"
    if kind == "ip4":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "ip6":
        # groups of zeros stay, so that the address can be written as short; later draws use all
        return _short([f"{1 + draw.below(65_535):x}" if attempt >= 8 or g != "0" else g for g in _groups(value)])
    if kind == "card":
        body = value[0] + "".join(str(draw.below(10)) for _ in value[1:-1])
        # the check digit is right exactly if the real one was
        last = next(str(d) for d in range(10) if _luhn(body + str(d)))
        return body + (last if _luhn(value) else str((int(last) + 1 + draw.below(9)) % 10))
    if kind == "ssn":
        return f"{100 + draw.below(565):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}"
    if kind == "phone":
        return str(2 + draw.below(8)) + "".join(str(draw.below(10)) for _ in value[1:])
    if kind == "iban":
        body = "".join(_like(c, draw) for c in value[4:])
        number = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
        return f"{value[:2]}{98 - number % 97:02d}{body}"
    if kind == "key":
        fixed = re.match(r"AKIA|ASIA|gh[pousr]_|sk[-_]", value)[0]
        return fixed + "".join(_like(c, draw) for c in value[len(fixed) :])
    if kind == "secret":
        hexadecimal = re.fullmatch(r"[0-9a-fA-F]+", value) is not None
        return "".join(_like(c, draw, hexadecimal) for c in value)
    _, script, *gender = kind.split("/")
    if gender and gender[0] == "n":
        gender = ["fm"[draw.below(2)]]
    names = GIVEN.get((script, *gender), []) if gender else FAMILY.get(script, [])
    if names and attempt < 3:
        return names[draw.below(len(names))].lower()
    if script != "latin":  # other scripts, or the list is used up
        return "".join(_like(c, draw) for c in value) + ("" if attempt < 8 or not value else _like(value[-1], draw))
    ending = {"f": "a", "m": "o"}.get(gender[0], "") if gender else "er"
    return "".join(_CONSONANTS[draw.below(16)] + _VOWELS[draw.below(5)] for _ in range(2 + attempt // 8)) + _CONSONANTS[draw.below(16)] + ending


def written(mention: str, kind: str, plain: str) -> str:
    """The surrogate in the layout of a mention: its separators and its upper and lower case."""
    if kind in ("card", "ssn", "phone", "iban"):
        kept = sum(c.isalnum() for c in mention) - len(plain)  # a country code stays
        rest = iter([c for c in mention if c.isalnum()][:kept] + list(plain))
        return "".join(next(rest) if c.isalnum() else c for c in mention)
    if kind.startswith(("given", "family")):
        if mention.isupper():
            return plain.upper()
        return plain[:1].upper() + plain[1:] if mention[:1].isupper() else plain
    if kind == "ip6":
        groups, tail = _groups(plain), []
        if "." in mention:
            tail = [str(ipaddress.IPv4Address((int(groups[6], 16) << 16) + int(groups[7], 16)))]
            groups = groups[:6]
        if "::" in mention:
            plain = _short(groups + tail)
        else:
            wide = all(len(g) == 4 for g in mention.split(":")[: len(groups)])
            plain = ":".join([g.zfill(4) if wide else g for g in groups] + tail)
        return plain.upper() if mention.upper() == mention != mention.lower() else plain
    if kind == "email" and mention.isupper():
        return plain.upper()
    return plain


ENTITY = T.StructType([
    T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()),
])
_DRAWN = T.StructType([T.StructField("surrogate", T.StringType())])


def surrogate_table(entities: DataFrame, key: bytes) -> DataFrame:
    """Rows (kind, value, surrogate) from rows (kind, value), no two of a kind with equal surrogates.

    Names of one kind of name, whatever gender, are checked together.  Every round draws for what
    is left and settles, for each surrogate, its smallest value; the rounds end because a later
    draw comes from a space without practical limit.
    """
    space = F.regexp_extract("kind", "^[^/]*", 0)
    real = staged(entities.select("kind", "value").distinct().withColumn("space", space))
    left = real
    settled = None
    attempt = 0
    while True:
        draw = lambda kind, value, n=attempt: (surrogate(key, kind, value, n),)
        drawn = staged(per_row(left, ["kind", "value"], _DRAWN, draw, ["kind", "value", "space"]))
        first = drawn.groupBy("space", "surrogate").agg(F.min(F.struct("value", "kind")).alias("who"))
        free = first.join(real.select("space", F.col("value").alias("surrogate")).distinct(), ["space", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        won = staged(free.select("who.kind", "who.value", "space", "surrogate"))
        settled = won if settled is None else staged(settled.union(won))
        left = staged(drawn.select("kind", "value", "space").join(won.select("kind", "value"), ["kind", "value"], "left_anti"))
        attempt += 1
        if not left.limit(1).count():
            return settled.select("kind", "value", "surrogate")
        if attempt == MAX_ROUNDS:
            raise ValueError("a kind of entity has more values than surrogates: its numbers are too short")


RESULT = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("n_replaced", T.IntegerType()),
    T.StructField("kinds", T.ArrayType(T.StringType())),
])


def _replace(text: str | None, table):
    if text is None:
        return None, 0, []
    known = {(r["kind"], r["value"]): r["surrogate"] for r in table or ()}
    out, at, kinds = [], 0, []
    if known:
        for start, end, kind, value in mentions(text):
            plain = known.get((kind, value))
            if plain is not None:
                out += [text[at:start], written(text[start:end], kind, plain)]
                at = end
                kinds.append(kind.split("/")[0])
    return "".join([*out, text[at:]]), len(kinds), sorted(set(kinds))


def replace(docs: DataFrame, key: bytes, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents with surrogates in their texts, and the table (kind, value, surrogate).

    Every row keeps its other columns and gets ``n_replaced`` and ``kinds`` (the kinds of entity
    found).  Null texts stay null, empty ones empty.  Equal entities get equal surrogates in all
    documents and all runs with the same key and corpus.  Repeated rows stay equal.  An empty table
    stays empty; input columns named n_replaced or kinds are replaced.
    """
    k1, k2 = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    keep = [c for c in docs.columns if c not in (text, "n_replaced", "kinds")]
    source = docs.select(F.col(text).alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    entity = lambda a, b, t: sorted({(a, b, kind, value) for _, _, kind, value in mentions(t)})
    found = staged(rows_of(source, ["k1", "k2", "text"], ENTITY, entity).distinct())
    table = surrogate_table(found, key)
    tables = staged(
        found.join(table, ["kind", "value"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("table"))
    )
    rows = docs.select(F.struct(*keep).alias("row") if keep else F.lit(None).alias("row"), F.col(text).alias("text"), k1.alias("k1"), k2.alias("k2"))
    rows = marked(rows, [F.col("k1"), F.col("k2")], tables.select("k1", "k2"))
    hit = rows.where("__maybe").join(tables, ["k1", "k2"], "left").select("row", "text", "table")
    rest = rows.where("not __maybe").select("row", "text", F.lit(None).cast(tables.schema["table"].dataType).alias("table"))
    done = per_row(hit.union(rest), ["text", "table"], RESULT, _replace, ["row"])
    shown = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c == text or c in keep]
    return done.select(*shown, "n_replaced", "kinds"), table
