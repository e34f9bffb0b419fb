"""Bring text that looks the same but differs in its characters to one form."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Letters of other scripts that fonts draw as the Latin (or Greek) one before the colon.
LOOKALIKES = {
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оοօ", "p": "р",
    "q": "ԛ", "s": "ѕ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у", "æ": "ӕ", "ə": "ә", "μ": "µ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν",
    "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ", "Æ": "Ӕ",
    "Γ": "Г", "Π": "П", "Φ": "Ф", "-": "‐‑", "’": "ʼ",
}
# The same for three further scripts, letter by letter: Lisu, Cherokee, Armenian.
LOOKALIKES_MORE = {
    **dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU", strict=True)),
    **dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPSTVWZ", strict=True)),
    **dict(zip("հոսցզՕՏ", "hnugqOS", strict=True)),
}

# Characters without any look of their own. Joiners are not here, for they depend on their neighbours.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x115F, 0x180E, 0x200B, 0x200E, 0x200F, 0x202A, 0x202C, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x2066, 0x2068, 0x2069, 0xFEFF, *range(0xFE00, 0xFE0E), *range(0x2065, 0x2070), 0x1160, 0xE0001]
JOINERS = [0x200C, 0x200D]

# Kinds of compatibility mapping that change no more than width, spacing or joining form.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")

_LIMIT = 0x110000
#: Scripts whose letters take another form next to a joiner: Arabic to Syriac and N'Ko, Indic, Sinhala, Khmer, Mongolian.
_JOINING = ((0x0600, 0x08FF), (0x0900, 0x0DFF), (0x1780, 0x18AF))
_EMOJI = ((0x2190, 0x21FF), (0x2300, 0x27BF), (0x2B00, 0x2BFF), (0x1F000, 0x1FAFF))


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points, made from the Unicode data of this Python once a process."""
    alike = {ord(x): ord(to) for to, several in LOOKALIKES.items() for x in several} | {ord(x): ord(to) for x, to in LOOKALIKES_MORE.items()}
    size, start = np.ones(_LIMIT, np.int32), np.arange(_LIMIT, dtype=np.int64)
    data: list[int] = []
    ccc = np.zeros(_LIMIT, np.uint8)
    pairs: dict[tuple[int, int], int] = {}

    def full(cp: int) -> list[int]:
        rule = unicodedata.decomposition(chr(cp)).split()
        if not rule:
            return [cp]
        if rule[0][0] == "<" and not (rule[0] in SAME_LOOK or 0xFB00 <= cp <= 0xFB06):
            return [cp]
        return [y for x in rule if x[0] != "<" for y in full(int(x, 16))]

    for cp in [*range(0x80, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)]:
        char = chr(cp)
        ccc[cp] = unicodedata.combining(char)
        rule = unicodedata.decomposition(char).split()
        if len(rule) == 2 and rule[0][0] != "<" and unicodedata.normalize("NFC", char) == char:
            pairs[int(rule[0], 16), int(rule[1], 16)] = cp
        if unicodedata.category(char) in ("Zs", "Zl", "Zp") or cp == 0x85:
            to = [0x20]
        else:
            to = [alike.get(x, x) for x in full(cp)]
        if to != [cp]:
            size[cp], start[cp] = len(to), -len(data) - 1
            data.extend(to)
    for cp in (*range(0x09, 0x0E), 0x1C, 0x1D, 0x1E, 0x1F):
        start[cp] = -len(data) - 1
        data.append(0x20)
    drop = np.zeros(_LIMIT, bool)
    drop[INVISIBLE] = True
    group = np.zeros(_LIMIT, np.uint8)
    for low, high in _JOINING:
        group[low : high + 1] = 1
    for low, high in _EMOJI:
        group[low : high + 1] = 2
    # Hangul syllables come from arithmetic: a leading and a vowel letter, then a trailing one.
    for i in range(19 * 21):
        pairs[0x1100 + i // 21, 0x1161 + i % 21] = 0xAC00 + i * 28
    keys = np.array([a << 21 | b for a, b in pairs], np.int64)
    order = np.argsort(keys)
    return {"size": size, "start": start, "data": np.array(data, np.int64), "ccc": ccc, "drop": drop, "group": group, "pair": keys[order], "made": np.array(list(pairs.values()), np.int64)[order]}


def _compose(first: np.ndarray, second: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Code point of each pair's composition, -1 where there is none."""
    key = first << 21 | second
    at = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
    made = np.where(t["pair"][at] == key, t["made"][at], -1)
    trailing = (first >= 0xAC00) & (first < 0xD7A4) & ((first - 0xAC00) % 28 == 0) & (second > 0x11A7) & (second < 0x11C3)
    return np.where(trailing, first + second - 0x11A7, made)


def normal_form(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One form of the code points of many texts at once; ``rows`` says to which text each belongs, in order."""
    t = _tables()
    # What has no look goes, and with it joiners that join nothing.
    keep = ~t["drop"][points]
    points, rows = points[keep], rows[keep]
    points, rows = _settle_joiners(points, rows, t)
    # Expansion: each code point gives `size` ones, gathered from the table or itself.
    hangul = (points >= 0xAC00) & (points < 0xD7A4)
    size, start = t["size"][points].astype(np.int64), t["start"][points]
    if len(points) and ((start < 0).any() or hangul.any()):
        size = np.where(hangul, np.where((points - 0xAC00) % 28 == 0, 2, 3), size)
        owner = np.repeat(np.arange(len(points)), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        base = points[owner]
        out = base.copy()
        mapped = start[owner] < 0
        out[mapped] = t["data"][-start[owner[mapped]] - 1 + place[mapped]]
        of = hangul[owner]
        s = base[of] - 0xAC00
        out[of] = np.choose(place[of], [0x1100 + s // 588, 0x1161 + s % 588 // 28, 0x11A7 + s % 28])
        points, rows = out, rows[owner]
    # Runs of spaces are one word break, and none stands at an end.
    if len(points):
        space = points == 0x20
        edge = np.r_[True, rows[1:] != rows[:-1]]
        last = np.r_[rows[1:] != rows[:-1], True]
        doubled = space & np.r_[False, space[:-1]] & ~edge
        keep = ~doubled
        points, rows, space = points[keep], rows[keep], space[keep]
        edge, last = np.r_[True, rows[1:] != rows[:-1]], np.r_[rows[1:] != rows[:-1], True]
        keep = ~(space & (edge | last))
        points, rows = points[keep], rows[keep]
    while True:
        points, rows, ccc = _compose_marks(points, rows, t)
        length = len(points)
        points, rows = _compose_starters(points, rows, ccc, t)
        if len(points) == length:  # else a new starter may take a mark that its parts could not
            return points, rows


def _settle_joiners(points: np.ndarray, rows: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keep joiners only between two emoji (one, if a zero-width joiner is there) or two letters of a joining script."""
    joiner = (points == JOINERS[0]) | (points == JOINERS[1])
    if not joiner.any():
        return points, rows
    index = np.arange(len(points))
    before = np.maximum.accumulate(np.where(joiner, -1, index))
    after = np.minimum.accumulate(np.where(joiner, len(points), index)[::-1])[::-1]
    a, b = before[joiner], after[joiner]
    at = index[joiner]
    inside = (a >= 0) & (b < len(points))
    a, b = np.where(inside, a, 0), np.where(inside, b, 0)
    inside &= (rows[a] == rows[at]) & (rows[b] == rows[at])
    left, right = t["group"][points[a]], t["group"][points[b]]
    # A variation selector or a mark stands between an emoji and its joiner.
    left = np.where((points[a] == 0xFE0F) & (a > 0), t["group"][points[a - 1]], left)
    first = np.r_[True, before[at][1:] != before[at][:-1]] if len(at) else np.zeros(0, bool)
    joins = points[at] == JOINERS[1]
    run = np.cumsum(first) - 1
    has = np.bincount(run, weights=joins, minlength=run.max(initial=-1) + 1) > 0
    ranked = np.zeros(len(at), np.int64)
    seen = np.flatnonzero(joins)
    ranked[seen] = np.r_[True, run[seen][1:] != run[seen][:-1]] if len(seen) else 0
    emoji = inside & (left == 2) & (right == 2) & has[run] & (ranked == 1)
    script = inside & (left == 1) & (right == 1)
    keep = ~joiner
    keep[at] = emoji | script
    return points[keep], rows[keep]


def _compose_marks(points: np.ndarray, rows: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order marks and compose them with their starters: the k-th mark of all segments in round k, so rounds follow the longest run of marks."""
    ccc = t["ccc"][points].astype(np.int64)
    marks = ccc > 0
    if not marks.any():
        return points, rows, ccc
    segment = np.cumsum(~marks | np.r_[True, rows[1:] != rows[:-1]])
    if (np.diff(ccc) < 0)[marks[1:] & marks[:-1] & (segment[1:] == segment[:-1])].any():
        # Canonical order: by class within the segment of a starter, equal classes as they stand.
        order = np.lexsort((ccc, segment))
        points, ccc = points[order], ccc[order]
    points = points.copy()
    starters = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    length = np.diff(np.r_[starters, len(points)])
    gone, last = np.zeros(len(points), bool), np.zeros(len(starters), np.int64)
    able = ccc[starters] == 0
    active = np.flatnonzero(able & (length > 1))
    k = 1
    while len(active):
        head, mark = starters[active], starters[active] + k
        made = _compose(points[head], points[mark], t)
        takes = (made >= 0) & (last[active] < ccc[mark])
        points[head[takes]] = made[takes]
        gone[mark[takes]] = True
        last[active] = np.where(takes, last[active], ccc[mark])
        k += 1
        active = active[length[active] > k]
    return points[~gone], rows[~gone], ccc[~gone]


def _compose_starters(points: np.ndarray, rows: np.ndarray, ccc: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Compose starters that stand side by side (Hangul letters and a few vowel signs), leftmost first."""
    high = (points >= 0x0900) & ((points < 0x1200) | (points >= 0x11000) | ((points >= 0xAC00) & (points < 0xD7A4)) | ((points >= 0x1B00) & (points < 0x1C00)))
    while len(points) > 1:
        near = np.flatnonzero(high[:-1] & high[1:] & (rows[1:] == rows[:-1]) & (ccc[1:] == 0) & (ccc[:-1] == 0))
        made = _compose(points[near], points[near + 1], t)
        near, made = near[made >= 0], made[made >= 0]
        if not len(near):
            break
        free = np.r_[True, near[1:] != near[:-1] + 1]
        near, made = near[free], made[free]
        points = points.copy()
        points[near] = made
        keep = np.ones(len(points), bool)
        keep[near + 1] = False
        points, rows, ccc, high = points[keep], rows[keep], ccc[keep], high[keep]
    return points, rows


def normalized_array(texts: pa.Array) -> pa.Array:
    """The one form of every text of an Arrow string array; null stays null.

    The text buffer becomes code points in one step, whatever the number of texts, and back again.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return pa.array([], pa.string())
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = memoryview(raw)[offsets[0] : offsets[-1]].tobytes() if raw is not None else b""
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    before = np.r_[0, np.cumsum(begins)]
    length = np.diff(before[offsets - offsets[0]])
    out, rows = normal_form(points, np.repeat(np.arange(n), length))
    width = 1 + (out >= 0x80).astype(np.int64) + (out >= 0x800) + (out >= 0x10000)
    sizes = np.bincount(rows, weights=width, minlength=n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)
    encoded = out.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    made = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64)), pa.py_buffer(encoded), _validity(texts), texts.null_count)
    return made.cast(pa.string())


def _validity(texts: pa.Array) -> pa.Buffer | None:
    return None if not texts.null_count else pa.py_buffer(np.packbits(np.asarray(texts.is_valid()), bitorder="little").tobytes())


def with_normal_form(df: DataFrame, columns: list[str], suffix: str = "_form") -> DataFrame:
    """Add the one form of each text column as ``<column><suffix>``.

    Equal forms mean: the same letters, accents, digits, marks and emoji in the same case and order, with the same word
    breaks. Width, ligatures, look-alike letters of other scripts, the order of accents and how they are composed,
    characters without a look, and the kind and number of spaces do not count; raised, circled or otherwise drawn signs stay
    what they are. Null gives null, an empty or blank text the empty text; very long texts are taken whole. A column
    that already has a new name is replaced.
    """
    made = [c + suffix for c in columns]
    df = df.drop(*made)
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.StringType()) for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [normalized_array(batch.column(batch.schema.get_field_index(c))) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *forms], names=[*batch.schema.names, *made])

    return df.mapInArrow(run, schema)


def look_alikes(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose two texts are there, differ in their characters and have the same form."""
    differ = df.where(df[left].isNotNull() & df[right].isNotNull() & (df[left] != df[right]))
    formed = with_normal_form(differ, [left, right])
    return formed.where(formed[left + "_form"] == formed[right + "_form"])
