"""PII surrogates: keyed, type-consistent replacements of personal data.

Found are e-mail addresses, phone numbers, IPv4 addresses, payment card and
account numbers, IBANs, US social security numbers, secrets (access keys,
passwords, tokens) and names: words after a form of address, and the same words
wherever else the text has them (from four letters on, unless it also has them
in lower case).

A replacement is a keyed permutation of all values of the same shape: digits
stay digits, letters stay letters of the same case, script and (in names) vowels
or consonants, signs stay where they are. Card numbers and IBANs with right
check digits keep such; private and loopback addresses stay in their networks
and public ones public. Names are replaced word by word, whatever form of address
they follow, so that a person keeps one surrogate with and without it; known
given names stay among the names of their gender and script. So equal entities
get equal surrogates in all documents, different ones get different ones, and a
shape survives. Checks over all entities of the input then find surrogates that
fall on an entity which really occurs, on themselves, or on each other; these
are drawn anew until none is left (given names, which many people share, are
distinct as they are). What finds nothing free in its own shape after a number
of turns, as others fill it, is drawn from wider ones, with more letters or
digits of the kind of its last one.

Cases: a null text stays null, with no entities; overlapping finds are settled
in favour of the earlier, then the longer one; repeated rows are replaced alike;
an empty table gives no rows; texts of any length are searched whole; other
columns are kept, those that clash with result columns are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.shared import store

BROADCAST_ROWS = 200_000
TRIES = 16  # turns within a value's own shape
WIDER = 4  # turns before a shape gets one more letter

# Forms of address.
ADDRESS = "Mr Sir Herr Herrn Monsieur M Señor Sr Don Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Sra Doña господин госпожа Dr Prof".split()
# Given names by script and gender; each list is permuted in itself.
GIVEN = {
    ("latin", "m"): "Adam Alan Andrew Anton Arthur Ben Bruno Carlos Charles Daniel David Diego Edward Emil Erik Felix Frank Fred George Hans Harry Henry Hugo Ivan Jack Jacob James Javier John Jonas Jorge Joseph Juan Karl Klaus Leo Louis Lucas Luis Marc Mark Martin Max Michael Miguel Nicolas Oliver Oscar Otto Pablo Paul Pedro Peter Pierre Ralph Robert Samuel Simon Stefan Thomas Tom Victor Walter William",
    ("latin", "f"): "Ada Agnes Alice Amelia Ana Anna Anne Beatrice Carla Carmen Caroline Charlotte Clara Claire Diana Dora Elena Elisa Elizabeth Ella Emily Emma Eva Fiona Gabriela Grace Greta Hanna Helen Helga Ida Ines Irene Isabel Jane Julia Karin Kate Laura Lea Lena Linda Lisa Louise Lucia Maria Marie Marta Mary Mia Monica Nina Nora Olga Paula Petra Rita Rosa Ruth Sara Sofia Sophie Susan Teresa Ursula Vera",
    ("cyrillic", "m"): "Алексей Андрей Антон Борис Виктор Владимир Григорий Дмитрий Иван Игорь Михаил Николай Олег Павел Пётр Сергей",
    ("cyrillic", "f"): "Алла Анна Вера Галина Дарья Елена Зоя Ирина Лариса Мария Надежда Наталья Нина Ольга Светлана Татьяна",
}
_LISTS = {k: sorted(v.split()) for k, v in GIVEN.items()}
_KNOWN = {name: k for k, names in _LISTS.items() for name in names}
_LETTER = r"[^\W\d_]"
_FORMS = "|".join(sorted(map(re.escape, ADDRESS), key=len, reverse=True))
# kind, what a text must hold to be searched, pattern; the group "v" is replaced
KINDS: list[tuple[str, re.Pattern | None, re.Pattern]] = [
    ("email", re.compile("@"), re.compile(r"(?<![\w.+-])(?P<v>[\w+-][\w.+-]{0,63}@[\w-]+(?:\.[\w-]+)+)")),
    ("secret", re.compile(r"AKIA|(?i:passw|token|secret|api|key)"), re.compile(r"\b(?P<v>AKIA[0-9A-Z]{16})\b")),
    ("secret", re.compile(r"(?i:passw|token|secret|api|key)"), re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?P<v>[A-Za-z0-9_+/.-]{6,}=*)")),
    ("iban", re.compile(r"[A-Z]{2}\d{2}"), re.compile(r"\b(?P<v>[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?)\b")),
    ("ip", re.compile(r"\d\.\d"), re.compile(r"(?<![\d.])(?P<v>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?\d)")),
    ("ssn", re.compile(r"\d-\d"), re.compile(r"(?<![\w-])(?P<v>\d{3}-\d{2}-\d{4})(?![\w-])")),
    ("phone", re.compile(r"\d"), re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?P<v>\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|(?<=[ .-])\d{2,4}[ .-]\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)")),
    ("account", re.compile(r"\d{4}"), re.compile(r"(?<![\w.])(?P<v>\d(?:[ -]?\d){11,18})(?![\w-])")),
    ("name", re.compile(rf"\b(?:{_FORMS})\b"), re.compile(rf"\b(?:{_FORMS})\.?[  ](?P<v>(?=[A-ZÀ-ÖØ-ÞА-ЯЁ]){_LETTER}+(?:[ -](?=[A-ZÀ-ÖØ-ÞА-ЯЁ]){_LETTER}+){{0,2}})")),
]


MENTION = 4  # letters of a word of a name that is looked for without a form of address


def _pieces(name: str) -> list[str]:
    """Words of a name, with what stands between them at odd places."""
    return re.split(r"([ \u00a0-])", name)


def _mentions(text: str, names: set[str]) -> re.Pattern | None:
    some = {w for name in names for w in _pieces(name)[::2] if len(w) >= MENTION}
    if some:
        said = set(re.findall(r"\w+", text))
        some -= {w for w in some if w.lower() in said}
    if not some:
        return None
    any_of = "|".join(sorted(map(re.escape, some)))
    return re.compile(rf"(?<![\w-])(?:{any_of})(?:[ \u00a0-](?:{any_of}))*(?![\w-])")


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text."""
    if not text:
        return []
    found = []
    for kind, needs, pattern in KINDS:
        if needs is not None and not needs.search(text):
            continue
        for m in pattern.finditer(text):
            start, end = m.span("v")
            if kind == "email":
                end = start + len(m["v"].rstrip(".-"))
            found.append((start, end, kind))
    again = _mentions(text, {text[a:z] for a, z, kind in found if kind == "name"})
    if again is not None:
        found += [(*m.span(), "name") for m in again.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for start, end, kind in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if not out or start >= out[-1][1]:
            out.append((start, end, kind))
    return out


def units(kind: str, value: str) -> list[tuple[str, str]]:
    """(kind, value) of what is replaced by itself: a name's words, or the entity."""
    if kind != "name":
        return [(kind, value)]
    return [("given" if w in _KNOWN else "name", w) for w in _pieces(value)[::2] if w]


_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"]
_SOUNDS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "äöüàâéèêëîïíóúáôù", "ÄÖÜÀÂÉÈÊËÎÏÍÓÚÁÔ"]
_CLASS = {c: a for a in _ALPHABETS for c in a}
_SOUND = {c: a for a in [*_SOUNDS, "0123456789"] for c in a}
_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}


def _permute(x: int, size: int, key: bytes) -> int:
    """A keyed permutation of 0..size-1: Feistel rounds with cycle walking."""
    if size < 2:
        return x
    half = (max(2, (size - 1).bit_length()) + 1) // 2
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = x >> half, x & mask
        for i in range(6):
            told = hashlib.blake2b(right.to_bytes(width, "big") + bytes([i]), key=key, digest_size=min(64, width)).digest()
            told = told if width <= 64 else hashlib.shake_128(told + key).digest(width)
            left, right = right, left ^ (int.from_bytes(told, "big") & mask)
        x = (left << half) | right
        if x < size:
            return x


def _key(secret: str, *parts: str) -> bytes:
    return hashlib.blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), key=hashlib.blake2b(secret.encode()).digest()[:32], digest_size=32).digest()


def reshape(value: str, classes: dict[str, str], secret: str, *parts: str) -> str:
    """Another value of the same shape, one for one under the same key and parts."""
    sets = [classes.get(c) for c in value]
    shape = "".join(c if a is None else a[0] for c, a in zip(value, sets, strict=True))
    x, size = 0, 1
    for c, a in zip(value, sets, strict=True):
        if a is not None:
            x, size = x * len(a) + a.index(c), size * len(a)
    x = _permute(x, size, _key(secret, *parts, shape))
    out = []
    for c, a in zip(reversed(value), reversed(sets), strict=True):
        if a is None:
            out.append(c)
        else:
            x, i = divmod(x, len(a))
            out.append(a[i])
    return "".join(reversed(out))


def _wider(value: str, classes: dict[str, str], turn: int) -> str:
    """``value``, from turn TRIES on with more letters like its last one after that."""
    if turn < TRIES:
        return value
    at = max((i + 1 for i, c in enumerate(value) if c in classes), default=len(value))
    more = value[at - 1] if at and value[at - 1] in classes else "a"
    return value[:at] + more * (1 + (turn - TRIES) // WIDER) + value[at:]


def _luhn(digits: str) -> int:
    """The check digit that makes a card number of these digits right."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _iban_check(country: str, rest: str) -> str:
    """The check digits that make an IBAN of this country and account right."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _spaced(like: str, signs: str) -> str:
    """The signs, in order, with the blanks and hyphens of ``like`` among them."""
    left, out = iter(signs), []
    for c in like:
        out.append(c if c in " -" else next(left, ""))
    return "".join(out) + "".join(left)


# Networks that stay within themselves (first address, size).
_NETWORKS = [(10 << 24, 1 << 24), (127 << 24, 1 << 24), ((172 << 24) | (16 << 16), 1 << 20), ((192 << 24) | (168 << 16), 1 << 16), ((169 << 24) | (254 << 16), 1 << 16)]


def _network(x: int) -> tuple[int, int] | None:
    return next((n for n in _NETWORKS if n[0] <= x < n[0] + n[1]), None)


def _address(value: str, secret: str, turn: str) -> str:
    x = 0
    for part in value.split("."):
        x = (x << 8) | int(part)
    own = _network(x)
    if own is not None:
        x = own[0] + _permute(x - own[0], own[1], _key(secret, "ip", turn, str(own[0])))
    else:
        key = _key(secret, "ip", turn)
        x = _permute(x, 1 << 32, key)
        while _network(x) is not None:  # walks on to the next public one
            x = _permute(x, 1 << 32, key)
    return f"{x >> 24}.{(x >> 16) & 255}.{(x >> 8) & 255}.{x & 255}"


@functools.lru_cache(maxsize=50_000)
def surrogate(kind: str, value: str, secret: str, turn: int = 0) -> str:
    """The replacement of a unit; further turns give further ones."""
    t = str(turn)
    if kind == "given":
        known = _KNOWN[value]
        names = _LISTS[known]
        return names[_permute(names.index(value), len(names), _key(secret, "given", *known))]
    if kind == "name":
        return reshape(_wider(value, _SOUND, turn), _SOUND, secret, "name", t)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        local = _wider(local, _CLASS, turn)
        host, dot, top = domain.rpartition(".")  # a domain keeps its ending, and meets others only as its original does
        return f"{reshape(local, _CLASS, secret, 'local', t)}@{reshape(host, _CLASS, secret, 'domain')}{dot}{top}"
    if kind == "ip":
        return _address(value, secret, t)
    if kind == "secret":
        head = 4 if value.startswith("AKIA") else 0
        classes = _HEX if re.fullmatch(r"[0-9a-f]+", value) else _CLASS
        return value[:head] + reshape(_wider(value[head:], classes, turn), classes, secret, "secret", t)
    if kind == "iban":
        plain = value.replace(" ", "")
        country, check, rest = plain[:2], plain[2:4], plain[4:]
        new = reshape(_wider(rest, _CLASS, turn), _CLASS, secret, "iban", t)
        right = check == _iban_check(country, rest)
        return _spaced(value, country + (_iban_check(country, new) if right else reshape(check, _CLASS, secret, "iban-check", t)) + new)
    if kind == "account":
        digits = re.sub("[ -]", "", value)
        if int(digits[-1]) == _luhn(digits[:-1]):
            new = reshape(_wider(digits[:-1], _CLASS, turn), _CLASS, secret, "card", t)
            return _spaced(value, new + str(_luhn(new)))
    return reshape(_wider(value, _CLASS, turn), _CLASS, secret, kind, t)


def replacement(kind: str, value: str, secret: str, turns: dict[tuple[str, str], int]) -> str:
    """The replacement of an entity, by those of its units."""
    if kind != "name":
        return surrogate(kind, value, secret, turns.get((kind, value), 0))
    return "".join(w if i % 2 or not w else surrogate(*u, secret, turns.get(u, 0)) for i, w in enumerate(_pieces(value)) for u in [("given" if w in _KNOWN else "name", w)])


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Stored distinct (kind, value) of the units of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {u for t in batch.column(0).to_pylist() for a, z, k in find(t) for u in units(k, t[a:z])}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], type=pa.string()), pa.array([v for _, v in seen], type=pa.string())], names=["kind", "value"])

    return store(docs.select(text_col).mapInArrow(run, "kind string, value string").distinct(), "entities")


def overrides(found: DataFrame, secret: str) -> DataFrame:
    """Stored (kind, value, turn) of entities whose first surrogate is not theirs
    to have: it occurs as an entity, or another entity has it."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values, turns = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(k, v, secret, t) for k, v, t in zip(kinds, values, turns, strict=True)], type=pa.string())], names=["kind", "value", "turn", "drawn"])

    schema = "kind string, value string, turn int, drawn string"
    now = store(found.withColumn("turn", F.lit(0)).mapInArrow(drawn, schema), "drawn")
    moved = None
    family = F.when(F.col("kind") == "given", "name").otherwise(F.col("kind"))
    while True:  # ends, as shapes widen
        taken = found.select(family.alias("family"), F.col("value").alias("drawn")).distinct().withColumn("real", F.lit(True))
        held = now.withColumn("family", family).groupBy("family", "drawn").agg(F.min(F.struct((F.col("kind") != "given").alias("free"), "turn", "kind", "value")).alias("owner"), F.count("*").alias("n")).filter("n > 1")
        marked = now.withColumn("family", family).join(taken, ["family", "drawn"], "left").join(held.select("family", "drawn", "owner"), ["family", "drawn"], "left")
        # one that has a surrogate already goes before those that are drawn anew
        loses = (F.col("kind") != "given") & (F.col("real").isNotNull() | (F.col("owner").isNotNull() & (F.struct((F.col("kind") != "given").alias("free"), "turn", "kind", "value") != F.col("owner"))))
        again = store(marked.filter(loses).select("kind", "value", (F.col("turn") + 1).alias("turn")), "again")
        if again.isEmpty():
            break
        moved = again if moved is None else moved.join(again, ["kind", "value"], "left_anti").unionByName(again)
        kept = now.join(again, ["kind", "value"], "left_anti")
        now = store(kept.unionByName(again.mapInArrow(drawn, schema)), "drawn")
    return store(moved, "overrides") if moved is not None else found.select("kind", "value", F.lit(0).alias("turn")).limit(0)


def replaced(text: str | None, secret: str, turns: dict[tuple[str, str], int]) -> tuple[str | None, list[dict]]:
    """A text with its surrogates, and the entities: kind, where each begins and
    ends in the new text."""
    if text is None:
        return None, []
    out, told, at, size = [], [], 0, 0
    for start, end, kind in find(text):
        value = text[start:end]
        new = replacement(kind, value, secret, turns)
        out += [text[at:start], new]
        size += start - at
        told.append({"kind": kind, "start": size, "end": size + len(new)})
        size += len(new)
        at = end
    return "".join([*out, text[at:]]), told


_TOLD = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_TOLD_SQL = "array<struct<kind:string,start:int,end:int>>"


def pseudonymise(docs: DataFrame, secret: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, and entities (kind, start, end)."""
    spark = docs.sparkSession
    found = entities(docs, text_col)
    moved = overrides(found, secret)
    base = docs.drop("entities", "__turns")
    n = moved.limit(BROADCAST_ROWS + 1).count()
    if n <= BROADCAST_ROWS:
        shared = spark.sparkContext.broadcast({(r["kind"], r["value"]): r["turn"] for r in moved.collect()})
        base = base.withColumn("__turns", F.lit(None).cast("array<struct<kind:string,value:string,turn:int>>"))
    else:  # too many to send to all: each document gets its own
        shared = spark.sparkContext.broadcast({})
        base = base.withColumn("__key", F.monotonically_increasing_id())
        base = store(base, "keyed")

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = {(i, *u) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a, z, k in find(t) for u in units(k, t[a:z])}
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["__key", "kind", "value"])

        mentions = base.select("__key", text_col).mapInArrow(own, "__key long, kind string, value string")
        by_doc = mentions.join(moved, ["kind", "value"]).groupBy("__key").agg(F.collect_list(F.struct("kind", "value", "turn")).alias("__turns"))
        base = base.join(by_doc, "__key", "left").drop("__key")
    names = base.columns
    at, last = names.index(text_col), names.index("__turns")
    kept = [c for c in names if c != "__turns"]
    schema = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in kept) + f", entities {_TOLD_SQL}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, told = [], []
            for text, turns in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True):
                new, entities = replaced(text, secret, shared.value if turns is None else {(t["kind"], t["value"]): t["turn"] for t in turns})
                texts.append(new)
                told.append(entities)
            cols = [pa.array(texts, type=pa.string()) if i == at else c for i, c in enumerate(batch.columns) if i != last]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(told, type=_TOLD)], names=[*kept, "entities"])

    return base.mapInArrow(run, schema)
