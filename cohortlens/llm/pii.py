"""Operator 7: surrogates for personal data.

Detected entities get replacements of the same type and format, drawn from a
keyed hash (HMAC-SHA-256) of the normal form of the entity: digits stay digits
in the same grouping, letters stay letters of the same script and case, card
numbers pass the Luhn check and keep their issuer digit, octets stay octets, a
given name becomes one of the same gender and script, bank accounts pass their
check with the same country.  Equal entities get equal surrogates in every text,
in whatever notation or digits of whatever script they stand, and the parts of a
name on their own, so mentions of one person stay together.

A name stands behind a title, or begins with a given name of the list.  Whether a
part is a given name or a surname, and its gender, is decided once for the whole
corpus: by the places that tell (of several parts the last is the surname), where
there are none by the lists and the title alone; equal evidence makes a surname,
and a given name of unknown gender gets one of either.

Distinctness is checked over the whole corpus: all distinct entities are drawn,
and of those that share a surrogate, or whose surrogate is itself a real entity
(all parts of names count as one type here), all but the first in the order of
the alphabet are drawn again with the next attempt, until none is left.

1. Detect (map only); distinct (text, entity), roles of name parts, distinct entities.
2. Draw with checks: joins on (type, surrogate); each round is a stored table.
3. Texts that hold entities meet their own entities' surrogates by content key
   and are rewritten; the other texts don't move.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from ipaddress import IPv6Address
from unicodedata import decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import stored, text_key

#: Setting that holds the secret key.  Without it the key below is used, which
#: anyone can read: right for tests only, as it lets the mapping be computed.
KEY_SETTING = "spark.cohortlens.surrogate.key"
KEY = b"surrogates-demo-key"
#: Kinds of the parts of names.
PARTS = ("surname", "given-f", "given-m", "given-u")

#: Given names by gender and script, and surnames by script (fixed lists).
GIVEN = {
    ("m", "latin"): "James John Robert Michael David William Richard Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Peter Karl Hans Pierre Jean Luis Carlos Miguel Jorge Pablo".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Anna Maria Greta Ursula Marie Claire Sofia Carmen Lucia Elena".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Павел Юрий".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Вера Юлия".split(),
}
SURNAMES = {
    "latin": "Adler Baxter Carver Dalton Ellison Fowler Garner Hayward Ingram Jarvis Keller Lorenz Mercer Norwood Osborne Prescott Quimby Ramsey Sutter Thorne Underhill Vance Whitaker Yardley Zeller".split(),
    "cyrillic": "Орлов Соколов Лебедев Козлов Новиков Морозов Волков Зайцев Павлов Семёнов".split(),
}
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Señora": "f", "Dr": "", "Prof": ""}
GENDER = {(n, s): g for (g, s), names in GIVEN.items() for n in names}

_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]*[a-zß-öø-ÿа-яё]"
#: Types in the order in which they claim text.
PATTERNS = {
    "email": r"(?<![\w\u0300-\u036f.%+-])[\w\u0300-\u036f%+-]+(?:\.[\w\u0300-\u036f%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<![\d.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|(?<!\d)\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d.])\+\d{1,3}(?:[ .-]?\d){7,12}(?!\d)",
    "name": r"\b(?:" + "|".join(TITLES) + r")\b\.?[ ](" + _NAME + r"(?:[ ]" + _NAME + r"){0,2})",
    "untitled": r"(?<!\w)((?:" + "|".join(n for names in GIVEN.values() for n in names) + r")[ ]" + _NAME + r")(?!\w)",
}
_COMPILED = [(k, re.compile(p)) for k, p in PATTERNS.items()]
#: A text that doesn't match this holds no entity (for the engine's own filter).
QUICK = (r"@[A-Za-z0-9-]|\p{Nd}[\p{Nd} .()-]{5,}\p{Nd}|\b(" + "|".join(TITLES) + r")\b\.? \p{Lu}|[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:"
         r"|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}|(?=\p{Lu})(?:" + "|".join(n for names in GIVEN.values() for n in names) + r") \p{Lu}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def script(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "latin"


def digits_of(found: str) -> str:
    """The decimal digits, whatever their script, as 0 to 9."""
    return "".join(str(decimal(c)) for c in found if c.isdecimal())


def normal(kind: str, found: str) -> str:
    """What two mentions of one entity have in common."""
    if kind == "email":
        return found.lower()
    if kind in ("card", "phone", "ssn"):
        return digits_of(found)
    if kind == "iban":
        return found.replace(" ", "")
    return str(IPv6Address(found)) if kind == "ipv6" else found


def account_check(iban: str) -> int:
    """Remainder by 97 of the account's number, its first four places last; 1 for a right one."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def is_ipv6(found: str) -> bool:
    """An address with three groups or more that are written out, and a digit (so no name scopes or times)."""
    try:
        IPv6Address(found)
    except ValueError:
        return False
    return sum(map(bool, found.split(":"))) >= 3 and any(c.isdigit() for c in found)


def checked_numbers(text: str, pattern: re.Pattern, right: Callable[[str], bool]) -> Iterator[re.Match]:
    """Matches that are ``right``: from each start the longest that ends at a group
    border; the search goes on behind it, or behind the first group."""
    at = 0
    while m := pattern.search(text, at):
        ends = [m.end(), *(i for i in range(m.end() - 1, m.start(), -1) if text[i] in " -")]
        good = (x for e in ends if (x := pattern.fullmatch(text, m.start(), e)) and right(x[0]))
        if found := next(good, None):
            yield found
        at = found.end() if found else min([i for i in ends if i > m.start()])


_RIGHT = {"card": lambda x: luhn(normal("card", x)), "iban": lambda x: account_check(normal("iban", x)) == 1}


def name_role(words: list[str], title: str) -> Iterator[tuple[str, str, bool]]:
    """(part, kind, sure): what one mention tells of the parts of a name."""
    for i, w in enumerate(words):
        listed = GENDER.get((w, script(w)), "")
        if i < len(words) - 1 or len(words) == 1 and listed:
            yield w, f"given-{listed or (TITLES.get(title, '') if i == 0 else '') or 'u'}", len(words) > 1
        else:
            yield w, "surname", len(words) > 1


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form), by start, without overlaps; a part of a
    name has the type that this text tells."""
    return [x[:4] for x in detect_sure(text)]


def detect_sure(text: str) -> list[tuple[int, int, str, str, bool]]:
    """As :func:`detect`, and whether a place tells the type of a part of a name."""
    taken: list[tuple[int, int, str, str, bool]] = []
    claimed = bytearray(len(text))

    def claim(a: int, b: int, kind: str, norm: str, sure: bool) -> None:
        if not any(claimed[a:b]):
            claimed[a:b] = b"\1" * (b - a)
            taken.append((a, b, kind, norm, sure))

    told: dict[str, list[tuple[bool, str]]] = {}
    for kind, pattern in _COMPILED:
        for m in checked_numbers(text, pattern, _RIGHT[kind]) if kind in _RIGHT else pattern.finditer(text):
            if kind in ("name", "untitled"):
                for part, role, sure in name_role(m[1].split(" "), re.match(r"\w+", m[0])[0]):
                    told.setdefault(part, []).append((sure, role))
            elif kind != "ipv6" or is_ipv6(m[0]):
                claim(m.start(), m.end(), kind, normal(kind, m[0]), True)
    if told:  # each mention of a part of a found name
        for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, sorted(told, key=len, reverse=True))) + r")\b", text):
            roles = told[m[0]]
            sure = max(x for x, _ in roles)
            best = [r for x, r in roles if x == sure]
            claim(m.start(), m.end(), decide(best.count("surname"), best.count("given-f"), best.count("given-m"), best.count("given-u")), m[0], sure)
    return sorted(taken)


def decide(surname: int, f: int, m: int, u: int) -> str:
    """The kind of a part of a name from the numbers of places that tell each."""
    if surname >= f + m + u:
        return "surname"
    return "given-f" if f > m else "given-m" if m > f else "given-u"


class _Stream:
    """Keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, norm: str, attempt: int):
        self.seed, self.n, self.left = hmac.new(key, f"{kind}\0{attempt}\0{norm}".encode(), hashlib.sha256).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 8:
            self.left += hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        x, self.left = int.from_bytes(self.left[:8], "big"), self.left[8:]
        return x % n


def draw(key: bytes, kind: str, norm: str, attempt: int) -> str:
    """The surrogate's normal form."""
    s = _Stream(key, kind, norm, attempt)
    digits = lambda n: "".join(str(s.below(10)) for _ in range(n))
    if kind == "email":
        local, _, domain = norm.rpartition("@")
        labels = domain.split(".")
        same = lambda t: "".join(chr(0x430 + s.below(32)) if "Ѐ" <= c <= "ӿ" else chr(97 + s.below(26)) if c.isalpha() else chr(ord(c) - decimal(c) + s.below(10)) if c.isdecimal() else c for c in t)
        more = chr(97 + s.below(26)) * (attempt // 8)  # a full format gets longer
        return same(local) + more + "@" + ".".join([*map(same, labels[:-1]), labels[-1]])
    if kind == "iban":
        body = "".join(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) for c in norm[4:])
        return f"{norm[:2]}{98 - account_check(norm[:2] + '00' + body):02d}{body}"
    if kind == "ipv6":  # groups of zeros stay, so that short notations stay short; a full format gets longer
        size = lambda g: min(4, len(g) + attempt // 4)
        groups = [f"{int(g, 16):x}" for g in IPv6Address(norm).exploded.split(":")]
        return str(IPv6Address(":".join(g if g == "0" else f"{1 + s.below(16 ** size(g) - 1):x}" for g in groups)))
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "ssn":
        return f"{1 + s.below(665):03d}{1 + s.below(99):02d}{1 + s.below(9999):04d}"
    if kind == "card":
        body = norm[0] + digits(len(norm) - 2)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "phone":
        keep = max(0, len(norm) - 10)
        return norm[:keep] + str(2 + s.below(8)) + digits(len(norm) - keep - 1)
    names = SURNAMES[script(norm)] if kind == "surname" else [n for g in kind[-1].replace("u", "mf") for n in GIVEN[g, script(norm)]]
    name = names[s.below(len(names))]
    for _ in range(attempt // 2):  # few names: the next attempts join several
        name += "-" + names[s.below(len(names))]
    return name


def dress(kind: str, found: str, surrogate: str) -> str:
    """The surrogate in the mention's own format, case and digits."""
    if kind == "email":
        if found.isupper():
            return surrogate.upper()
        return "".join(c.upper() if i < len(found) and found[i].isupper() else c for i, c in enumerate(surrogate))
    if kind in ("card", "phone", "ssn"):
        it = iter(surrogate)
        return "".join(chr(ord(c) - decimal(c) + int(next(it))) if c.isdecimal() else c for c in found)
    if kind == "iban":
        it = iter(surrogate)
        return "".join(c if c == " " else next(it) for c in found)
    if kind == "ipv6":
        if "::" not in found:
            full = any(len(g) > 1 and g[0] == "0" for g in found.split(":"))
            surrogate = ":".join(g if full else f"{int(g, 16):x}" for g in IPv6Address(surrogate).exploded.split(":"))
        return surrogate.upper() if found.isupper() else surrogate
    return surrogate.upper() if found.isupper() and len(found) > 1 else surrogate


def rewrite(text: str, given: dict[tuple[str, str], str]) -> str:
    out, at = [], 0
    for a, b, kind, norm in detect(text):
        kind = "name" if kind in PARTS else kind
        out += [text[at:a], dress(kind, text[a:b], given[kind, norm])]
        at = b
    return "".join([*out, text[at:]])


def mentions(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(key, kind, norm, sure): distinct entities of each distinct text; ``sure``: a
    place of the text tells the kind of a part of a name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *x) for k, t in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True)
                    for x in sorted({x[2:] for x in detect_sure(t)})]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "kind", "norm", "sure"])

    types = [pa.string(), pa.string(), pa.string(), pa.bool_()]
    text = F.col(text_column).cast("string")
    some = docs.where(text.rlike(QUICK)).select(text_key(text).alias("key"), text.alias("text"))
    return some.mapInArrow(run, "key string, kind string, norm string, sure boolean").distinct()


def person_parts(found: DataFrame) -> DataFrame:
    """(kind, norm): one kind for each part of a name, by all texts: those that are
    sure where there are any, else the others (:func:`decide`, over texts)."""
    def texts(kind: str, sure: bool) -> Column:
        return F.count_if((F.col("kind") == kind) & (F.col("sure") == sure))

    votes = found.where(F.col("kind").isin(*PARTS)).groupBy("norm").agg(
        F.count_if("sure").alias("n_sure"), *[texts(k, x).alias(f"{k}-{x}") for k in PARTS for x in (True, False)])
    surname, f, m, u = (F.when(F.col("n_sure") > 0, F.col(f"{k}-True")).otherwise(F.col(f"{k}-False")) for k in PARTS)
    kind = F.when(surname >= f + m + u, "surname").when(f > m, "given-f").when(m > f, "given-m").otherwise("given-u")
    return votes.select(kind.alias("kind"), "norm")


def assign(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, norm, surrogate): one surrogate per entity, no two alike within a
    kind, and none that is a real entity of that kind; the kinds of the parts of
    names are one in this."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, norms, attempts = (batch.column(i).to_pylist() for i in range(3))
            got = [draw(key, k, n, a) for k, n, a in zip(kinds, norms, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], ["kind", "norm", "attempt", "surrogate"])

    among = F.when(F.col("kind").isin(*PARTS), "name").otherwise(F.col("kind")).alias("among")
    real = entities.select(among, F.col("norm").alias("surrogate"))
    todo, done = entities.withColumn("attempt", F.lit(0)), None
    while True:
        drawn = todo.select("kind", "norm", "attempt").mapInArrow(run, "kind string, norm string, attempt int, surrogate string")
        first = F.min("norm").alias("first")
        drawn = stored(drawn.withColumn("among", among), "drawn")
        taken = real.withColumn("taken", F.lit(True))
        if done is not None:
            taken = taken.union(done.select(among, "surrogate", F.lit(True)))
        checked = stored(drawn.join(drawn.groupBy("among", "surrogate").agg(first), ["among", "surrogate"]).join(taken.distinct(), ["among", "surrogate"], "left")
                         .withColumn("ok", F.col("taken").isNull() & (F.col("norm") == F.col("first"))), "checked")
        good = checked.where("ok").select("kind", "norm", "surrogate")
        done = good if done is None else done.union(good)
        todo = checked.where("NOT ok").select("kind", "norm", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return done


def secret_key(spark: SparkSession) -> bytes:
    """The session's key (``KEY_SETTING``), or the one for tests."""
    return (spark.conf.get(KEY_SETTING, None) or KEY.decode()).encode()


def replace_pii(docs: DataFrame, key: bytes | None = None, text_column: str = "text") -> DataFrame:
    """``docs`` with the entities in its texts replaced; all columns and rows stay.

    Null and empty texts, and texts without entities, stay as they are, as do
    null ids; repeated rows are rewritten alike.  Of entities that draw the same
    surrogate the first in the order of the alphabet keeps it.  ``key``: that of the
    session, if not given.
    """
    key = secret_key(docs.sparkSession) if key is None else key
    own = F.col(text_column).cast("string")
    found = stored(mentions(docs, text_column), "mentions")
    others = found.where(~F.col("kind").isin(*PARTS)).select("kind", "norm").distinct()
    entities = stored(others.union(person_parts(found)), "entities")
    plain = F.when(F.col("kind").isin(*PARTS), "name").otherwise(F.col("kind")).alias("kind")
    given = assign(entities, key).select(plain, "norm", "surrogate")
    # A text's own entities: bounded by its length.
    per_text = found.select("key", plain, "norm").distinct().join(given, ["kind", "norm"]).groupBy("key").agg(F.collect_list(F.concat_ws("\0", "kind", "norm", "surrogate")).alias("given"))
    may = F.coalesce(own.rlike(QUICK), F.lit(False))
    names = docs.columns
    # Own names for what is added, whatever columns there are.
    k, g = "\0key", "\0given"
    some = docs.where(may).withColumn(k, text_key(own))
    met = some.join(per_text.select(F.col("key").alias(k), F.col("given").alias(g)), k, "left")

    @F.pandas_udf("string")
    def apply(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([t if x is None or not len(x) else rewrite(t, {(p[0], p[1]): p[2] for p in (e.split("\0") for e in x)}) for t, x in zip(texts, lists, strict=True)], dtype=object)

    changed = met.withColumn(text_column, apply(own, F.col(g))).select(*[F.col(f"`{c}`") for c in names])
    return docs.where(~may).withColumn(text_column, own).select(*[F.col(f"`{c}`") for c in names]).union(changed)
