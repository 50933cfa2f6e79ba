"""Text that was decoded with the wrong character encoding.

Method: a multinomial classifier over hashed byte bigrams predicts the encoding chain of a value
(what its bytes were, and as what they were read) or that it is clean. It is trained on values of
the table itself, a bounded sample of the distinct ones, and on words of every alphabet, each garbled by
every chain. A chain that inverts the value strictly (every byte decodes, and the chain leads back to the
value) gains what that is worth as evidence: how rarely it happens to clean values. The best class is
the verdict; if it is a chain that inverts, the original is regained. Values that lost characters or
letter case are found, but not restored.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encoding chains, (what the bytes were, as what they were read).
CHAINS = (
    ("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "cp1250"), ("utf-8", "cp1251"), ("utf-8", "cp1254"), ("utf-8", "cp437"),
    ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("utf-8", "koi8-r"), ("utf-8", "gbk"), ("utf-8", "big5"), ("utf-8", "shift_jis"),
    ("gbk", "latin-1"), ("gbk", "cp1252"), ("gbk", "cp1251"), ("big5", "latin-1"), ("shift_jis", "latin-1"), ("shift_jis", "cp1252"),
    ("euc_jp", "latin-1"), ("cp1251", "latin-1"), ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("koi8-r", "latin-1"),
    ("cp1252", "cp437"), ("cp1252", "cp1251"), ("cp1252", "utf-8"), ("gbk", "utf-8"), ("gbk", "shift_jis"), ("shift_jis", "gbk"), ("gbk", "mac_roman"), ("cp1251", "mac_roman"),
)
_DOUBLE = (("utf-8", "cp1252"), ("utf-8", "latin-1"))
_WIDE = frozenset(("gbk", "big5", "shift_jis", "euc_jp", "utf-8"))
BUCKETS = 1 << 15
CLEAN = 0


def _tables(name: str) -> tuple[list[str], dict[str, int]]:
    """Byte to character and back; bytes that the encoding lacks are read as control characters."""
    there = []
    for b in range(256):
        try:
            there.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            there.append(chr(b))
    back: dict[str, int] = {}
    for b, c in enumerate(there):
        back.setdefault(c, b)
    return there, back


_TABLES = {n: _tables(n) for n in {w for _, w in CHAINS} - _WIDE}


def _read(data: bytes, wrong: str) -> str:
    if wrong in _WIDE:
        return data.decode(wrong, errors="replace")
    try:
        return data.decode(wrong)
    except UnicodeDecodeError:
        there = _TABLES[wrong][0]
        return "".join([there[b] for b in data])


def _unread(text: str, wrong: str) -> bytes | None:
    try:
        return text.encode(wrong)
    except UnicodeEncodeError as e:
        # only bytes that the encoding lacks are beyond its own table
        if wrong in _WIDE or not "\x80" <= text[e.start] <= "\x9f":
            return None
    back = _TABLES[wrong][1]
    try:
        return bytes([back[c] for c in text])
    except KeyError:
        return None


#: All classes but CLEAN, as lists of steps in the order in which they garbled.
STEPS: tuple[tuple[tuple[str, str], ...], ...] = (*((c,) for c in CHAINS), *((c, c) for c in _DOUBLE))


def garble(text: str, steps: tuple[tuple[str, str], ...]) -> str | None:
    """The text after the chain; None if the chain cannot take it or leaves it as it is."""
    out = text
    for was, wrong in steps:
        try:
            out = _read(out.encode(was), wrong)
        except UnicodeEncodeError:
            return None
    return out if out != text else None


def invert(text: str, steps: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the chain, if every step decodes strictly and the chain leads back again."""
    out = text
    for was, wrong in reversed(steps):
        data = _unread(out, wrong)
        if data is None:
            return None
        try:
            out = data.decode(was)
        except UnicodeDecodeError:
            return None
    return out if out != text and garble(out, steps) == text else None


def bigrams(data: bytes) -> np.ndarray:
    """Hashed pairs of neighbouring bytes, those of two ASCII bytes left out."""
    a = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    left, right = a[:-1], a[1:]
    keep = (left | right) >= 0x80
    return ((left[keep] << 8 | right[keep]) * np.uint32(2654435761)) >> np.uint32(32 - 15)


#: Control characters that no name holds, and what a decoder puts where it found no character.
def lost(text: str) -> bool:
    return any(c == "�" or "\x80" <= c <= "\x9f" or unicodedata.category(c) == "Co" for c in text)


class Model:
    """``weights`` of classes and hashed bigrams, and for each chain what a strict inversion is worth as evidence."""

    def __init__(self, weights: np.ndarray, decodes: np.ndarray):
        self.weights, self.decodes = weights, decodes
        self.memo: dict[str, tuple[int, str | None]] = {}

    def scores(self, text: str) -> np.ndarray:
        return self.weights[:, bigrams(text.encode("utf-8", "surrogatepass"))].sum(axis=1)

    def judge(self, text: str | None) -> tuple[int, str | None]:
        """(class, original): CLEAN, or 1 and more for a chain, with the original if it is regained."""
        if text is None or text.isascii():
            return CLEAN, None
        hit = self.memo.get(text)
        if hit is None:
            hit = self._judge(text)
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[text] = hit
        return hit

    def _judge(self, text: str) -> tuple[int, str | None]:
        s = self.scores(text)
        s[CLEAN] += PRIOR
        backs: dict[int, str] = {}
        odd = sum(c > "\x7f" for c in text)
        for c in np.argsort(-s):
            # what its decoding may be worth cannot lift the chain above the clean class
            if s[c] + self.decodes[c] + (math.log(4) * odd if c in _UTF8 else 0.0) < s[CLEAN]:
                continue
            if c != CLEAN and c not in _LOSSY and (back := restored(text, STEPS[c - 1])) is not None and self.reads_better(back, text, PRIOR if c in _UTF8 else BETTER):
                backs[int(c)] = back
                s[c] += self.decodes[c]
                if c in _UTF8:
                    # one value of a byte in four goes on with a character: each that does so is evidence
                    s[c] += math.log(4) * sum(len(x.encode()) - 1 for x in back)
        best = int(np.argmax(s))
        if best != CLEAN and best in backs:
            return best, backs[best]
        # what no chain gives back has lost characters, or its letter case was changed after it was garbled
        first = next(int(c) for c in np.argsort(-s) if c != CLEAN)
        far = s[first] - s[CLEAN]
        if lost(text) or best != CLEAN and (self.recased(text) or far > SURE and far > SURE_EACH * len(bigrams(text.encode("utf-8", "surrogatepass")))):
            return first, None
        return CLEAN, None

    def reads_better(self, back: str, text: str, better: float) -> bool:
        """Whether what came back is by ``better`` likelier as a clean value than the value is."""
        w = self.weights[CLEAN]
        return w[bigrams(back.encode())].sum() > w[bigrams(text.encode("utf-8", "surrogatepass"))].sum() + better

    def recased(self, text: str) -> bool:
        """Whether a value in lower case, with capitals given back to its odd letters, comes of a chain from UTF-8."""
        if text != text.lower():
            return False
        pairs = list(zip(text, text[1:] + " "))
        for up in {"".join([_up(c, d) for c, d in pairs]), "".join([_up(c, d) if d > "\x7f" or c == "ÿ" else c for c, d in pairs])} - {text}:
            if any((back := restored(up, STEPS[c - 1])) is not None and self.reads_better(back, text, BETTER) for c in _UTF8):
                return True
        return False


def _up(c: str, after: str) -> str:
    """The capital that a letter of a garbled text was, if it was one."""
    if c == "ÿ":
        return "Ÿ"
    if c == "â" and (after in "€‚„" or "\x80" <= after <= "\x9f"):
        return c
    u = c.upper()
    return u if c > "\x7f" and len(u) == 1 and c not in "µƒßªº" else c


def restored(text: str, steps: tuple[tuple[str, str], ...]) -> str | None:
    """The strict inversion of a value; blanks may stand for no-break spaces that were part of a character."""
    back = invert(text, steps)
    if back is None and " " in text and steps[-1][0] == "utf-8":
        back = next((x for m in _SPACED.finditer(text) if (x := invert(text[: m.start()] + "\xa0" + text[m.end() :], steps))), None)
    return None if back is None or lost(back) or back.isascii() else back


#: Chains read as UTF-8 leave replacement characters or nothing wrong: there is nothing to invert.
_LOSSY = frozenset(i + 1 for i, s in enumerate(STEPS) if s[-1][1] == "utf-8")
_SPACED = re.compile(r"(?<=[^\x00-\x7f]) (?=[^\x00-\x7f]|$)")
#: What speaks for a clean value from the start, and how far beyond it, in all and for each pair of bytes, a
#: chain has to be for a value that it does not give back (a blank or a letter of it was changed, too); and how
#: much likelier the original has to be where a strict decoding alone proves little.
PRIOR, SURE, SURE_EACH, BETTER = 4.0, 60.0, 2.5, 14.0
#: Blocks of letters, as ranges of code points, from which words are made so that no script is unknown.
_BLOCKS = (
    (0xC0, 0x17F), (0x1E00, 0x1EFF), (0x386, 0x3CE), (0x400, 0x45F), (0x490, 0x4E9), (0x531, 0x586), (0x5D0, 0x5EA), (0x621, 0x64A), (0x671, 0x6D3), (0x905, 0x94D), (0x985, 0x9CD), (0xA85, 0xACD), (0xB85, 0xBCD), (0xC05, 0xC4D), (0xC85, 0xCCD), (0xD05, 0xD4D),
    (0xE01, 0xE4E), (0xE81, 0xECD), (0x1000, 0x103F), (0x10D0, 0x10F0), (0x1200, 0x1357), (0x1780, 0x17D2), (0x3041, 0x3096), (0x30A1, 0x30FC), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)


def alphabet_words(each: int = 40, seed: int = 3) -> list[str]:
    """Words of letters of one script each, by a seeded rule; Latin letters stand among ASCII ones."""
    r = random.Random(seed)
    out = []
    for first, last in _BLOCKS:
        letters = [c for i in range(first, last + 1) if unicodedata.category(c := chr(i))[0] in "LM"]
        small = [c for c in letters if unicodedata.category(c) not in ("Lu", "Lt")] or letters
        for _ in range(each):
            word = [r.choice(small) for _ in range(r.randint(3, 9))]
            if first in (0xC0, 0x1E00):
                word = [r.choice("aeioubcdfglmnrst") if r.random() < 0.7 else c for c in word]
            elif r.random() < 0.5:
                word[0] = r.choice(letters)
            out.append("".join(word))
    return out


def train(values: list[str], rounds: int = 2) -> Model:
    """Learns from clean values and words of every alphabet: each garbled by every chain, also in lower
    and in upper case.

    Values that lost characters, and at first those that a chain from UTF-8 restores, are left out as
    garbled; then, ``rounds`` times, those that the model itself calls garbled, whatever script they are in.
    """
    known = alphabet_words()
    clean = [v for v in values if not lost(v) and not any(restored(v, STEPS[c - 1]) for c in _UTF8)]
    model = _fit([*clean, *known])
    for _ in range(rounds):
        clean = [v for v in values if not lost(v) and model._judge(v)[0] == CLEAN]
        model = _fit([*clean, *known])
    return model


#: Chains from UTF-8 over one byte a character.
_UTF8 = frozenset(i + 1 for i, s in enumerate(STEPS) if s[0][0] == "utf-8" and s[0][1] not in _WIDE)


def _fit(clean: list[str]) -> Model:
    groups: list[list[str]] = [[*clean, *(v.lower() for v in clean), *(v.upper() for v in clean)]]
    for steps in STEPS:
        bad = [g for v in clean if not v.isascii() and (g := garble(v, steps))]
        groups.append([*bad, *bad, *(g.lower() for g in bad), *(g.upper() for g in bad)])
    counts = np.stack([np.bincount(bigrams("\n".join(g).encode("utf-8", "surrogatepass")), minlength=BUCKETS) for g in groups]).astype(float)
    total = counts.sum(axis=1, keepdims=True)
    weights = np.log((counts + 0.02) / (total + 0.02 * BUCKETS))
    # how often a chain inverts a clean value by chance tells what an inversion is worth
    odd = [v for v in clean if not v.isascii()]
    by_chance = [(sum(restored(v, s) is not None for v in odd) + 0.5) / (len(odd) + 1) for s in STEPS]
    return Model(weights, np.array([0.0, *(-np.log(by_chance))]))


def training_values(rows: DataFrame, columns: list[str], bound: int = 4000) -> list[str]:
    """About ``bound`` distinct values that are not ASCII alone: those whose hash is small enough."""
    values = rows.select(F.explode(F.array(*columns)).alias("v")).where("v is not null and v rlike '[^\\\\x00-\\\\x7f]'").distinct()
    n = values.agg(F.approx_count_distinct("v")).first()[0]
    share = min(1.0, bound / max(1, n))
    return sorted(r.v for r in values.where(F.pmod(F.xxhash64("v"), F.lit(1 << 48)) < int(share * (1 << 48))).collect())


#: Words with which training does not depend on what a table happens to hold.
_WORDS = (
    "Über größe Straße société générale élève français ação São não informação współpraca społeczność łódź příklad společnost řízení çalışma hakkında şirket ığdır åäö smörgås Ångström niño España "
    "компания общество завод Россия ООО «Прогресс» 公司 有限公司 科技股份 自动化 关于 联系我们 中国 上海 株式会社 会社概要 製作所 工業 カタカナ サービス – — ’ ™ ® «» „“ é ü ö ä ß"
).split()


def judged(rows: DataFrame, key: str, columns: list[str], bound: int = 4000) -> DataFrame:
    """(key, field_name, chain, original) of every value that shows a wrongly decoded text.

    ``original`` is null where it cannot be regained. Null and ASCII values are clean. A row
    delivered twice counts once. ``bound`` is the number of values to train on; an empty table
    trains on a few fixed words and gives an empty result.
    """
    made = train([*training_values(rows, columns, bound), *_WORDS])
    shared = rows.sparkSession.sparkContext.broadcast((made.weights.astype(np.float32), made.decodes))  # classes x buckets, 5 MB whatever the input
    kind = rows.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in batches:
            ids = b.column(0).to_pylist()
            out: list[list] = [[], [], [], []]
            for j, name in enumerate(columns):
                for i, v in zip(ids, b.column(j + 1).to_pylist()):
                    c, back = model.judge(v)
                    if c != CLEAN:
                        for o, x in zip(out, (i, name, " ".join(f"{a}>{w}" for a, w in STEPS[c - 1]), back)):
                            o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), *(pa.array(o, pa.string()) for o in out[1:])], names=[key, "field_name", "chain", "original"])

    return rows.select(key, *columns).mapInArrow(judge, f"`{key}` {kind}, field_name string, chain string, original string").dropDuplicates([key, "field_name"])


def found(items: DataFrame) -> DataFrame:
    """(item_id, field_name) of the values of company and website that are wrongly decoded."""
    return judged(items, "item_id", ["company", "website"]).select("item_id", "field_name")
