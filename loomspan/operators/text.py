"""Words, annotation units and quotations in texts, in built-in expressions where Spark has them."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word: letters and digits, also after an apostrophe inside.
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
#: An event marker in a transcript, such as {BR}.
MARKER = r"\{[^{}]*\}"

#: Most phrases that are broadcast; more are joined by their first token, with equal results.
MOST_PHRASES = 1_000

# Spoken contractions and what they stand for.
EXPANSIONS = {
    "gonna": "going to", "wanna": "want to", "gotta": "got to", "kinda": "kind of", "sorta": "sort of", "outta": "out of",
    "i'm": "i am", "you're": "you are", "we're": "we are", "they're": "they are", "i've": "i have", "you've": "you have",
    "we've": "we have", "they've": "they have", "can't": "can not", "cannot": "can not", "won't": "will not", "don't": "do not",
    "doesn't": "does not", "didn't": "did not", "isn't": "is not", "wasn't": "was not", "weren't": "were not", "aren't": "are not",
    "couldn't": "could not", "wouldn't": "would not", "shouldn't": "should not",
}
# Words after which a period ends no unit.
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "prof", "st", "jr", "sr", "vs", "etc"]
# Fixed value: labels of timing intervals that are events, not words.
EVENT_LABEL = r"(?i)^(?:[{\[]?\s*(?:BR|LG|LS|NS|CG)\s*[}\]]?|sp|sil|SENTENCE[\s_]*(?:START|END))$"


def masked(text: str = "text") -> Column:
    """The text with every marker as spaces of the same length, so offsets stay."""
    gaps, markers = F.split(text, MARKER, -1), F.regexp_extract_all(F.col(text), F.lit(MARKER), F.lit(0))
    blank = F.transform(markers, lambda m: F.repeat(F.lit(" "), F.length(m)))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), F.concat(blank, F.array(F.lit(""))).alias("b")), lambda z: F.array(z.g, z.b))), "")


def words(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Words with their places: ``key, idx, word, char_start, char_end, gap``; offsets in code points, half-open.

    ``gap`` is what stands between a word and the next. Null and wordless texts give no rows. The pieces between words give the
    offsets, so no Python is needed. Texts are spread by key before they are cut into words: the windows over a text, here and in
    ``unit_boundaries``, and groups by key then need no shuffle of the many more and longer word rows.
    """
    found = df.select(key, F.col(text).alias("_t")).where(F.regexp_like("_t", F.lit(r"[\p{L}\p{N}]"))).repartition(key).select(key, masked("_t").alias("_t"))
    zipped = F.arrays_zip(F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("word"), F.split("_t", WORD, -1).alias("before"), F.slice(F.split("_t", WORD, -1), 2, 2**31 - 1).alias("gap"))
    each = found.select(key, F.posexplode(zipped).alias("idx", "z")).where(F.col("z.word").isNotNull()).select(key, "idx", "z.word", "z.before", "z.gap")
    upto = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("before") + F.length("word")).over(upto).cast("int")
    return each.withColumn("char_end", end).select(key, "idx", "word", (F.col("char_end") - F.length("word")).alias("char_start"), "char_end", "gap")


def unit_boundaries(w: DataFrame, key: str) -> DataFrame:
    """Add ``boundary`` and ``unit``: a unit ends where the gap holds . ? or !, and at the last word.

    A period does not count after an abbreviation, after a single capital letter before another word, or as all there is between two numbers.
    """
    order = Window.partitionBy(key).orderBy("idx")
    following = F.lead("word").over(order)
    more = following.isNotNull()
    number = F.regexp_like("word", F.lit(r"^\p{N}+$"))
    initial = (F.length("word") == 1) & (F.upper("word") == F.col("word")) & (F.lower("word") != F.col("word")) & more
    decimal = number & F.coalesce(F.regexp_like(following, F.lit(r"^\p{N}+$")), F.lit(False)) & (F.col("gap") == ".")
    period = F.contains("gap", F.lit(".")) & ~F.lower("word").isin(ABBREVIATIONS) & ~initial & ~decimal
    marked = w.withColumn("boundary", ~more | period | F.contains("gap", F.lit("?")) | F.contains("gap", F.lit("!")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("unit", F.coalesce(F.sum(F.col("boundary").cast("int")).over(before), F.lit(0)).cast("int"))


def units(w: DataFrame, key: str) -> DataFrame:
    """Units of segmented words: ``key, unit, start_token, end_token, char_start, char_end``, half-open."""
    return w.groupBy(key, "unit").agg(F.min("idx").alias("start_token"), (F.max("idx") + 1).alias("end_token"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))


def expanded(w: DataFrame, key: str) -> DataFrame:
    """Words in lower case with contractions written out: ``key, idx, part, token``."""
    plain = F.translate(F.lower("word"), "’", "'")
    table = F.create_map(*[F.lit(x) for pair in EXPANSIONS.items() for x in pair])
    parts = F.split(F.coalesce(F.try_element_at(table, plain), plain), " ")
    return w.select(key, "idx", F.posexplode(parts).alias("part", "token"))


def phrase_positions(w: DataFrame, key: str, phrases: DataFrame, phrase_key: str, most_sent: int = MOST_PHRASES) -> DataFrame:
    """All places of phrases of any number of words: ``phrase_key, key, start_token``.

    ``phrases``: ``phrase_key, tokens`` (lower case). As ``text_phrases``, over words that are cut already; a place has all its words at following ``idx``.
    """
    placed = F.collect_list(F.struct("idx", F.lower("word").alias("token")))
    return _phrase_places(w.groupBy(key).agg(F.array_sort(placed).alias("_words")), key, phrases, phrase_key, most_sent)


def text_phrases(df: DataFrame, key: str, phrases: DataFrame, phrase_key: str, text: str = "text", most_sent: int = MOST_PHRASES) -> DataFrame:
    """All places of phrases in texts, as ``phrase_positions`` gives them for ``words``: ``phrase_key, key, start_token``.

    Each text meets the phrases where it lies, so neither texts nor words are shuffled. Null and empty phrases and null tokens are not found, null texts have no
    places; texts with the same key are searched one by one.
    """
    cut = F.regexp_extract_all(masked(text), F.lit(WORD), F.lit(0))
    return _phrase_places(df.select(key, F.transform(cut, lambda x, i: F.struct(i.alias("idx"), F.lower(x).alias("token"))).alias("_words")), key, phrases, phrase_key, most_sent)


def _phrase_places(texts: DataFrame, key: str, phrases: DataFrame, phrase_key: str, most_sent: int) -> DataFrame:
    """Places of phrases; ``texts``: ``key, _words`` with the words (``idx, token``) in order.

    Only where a text has the first token of a phrase, that word and those that follow become a row, as many as the longest phrase with this token may need;
    it meets the phrases of its first token. Up to ``most_sent`` phrases are broadcast; more of them are joined by first token, and then every word becomes a row.
    """
    asked = phrases.where((F.size("tokens") > 0) & ~F.exists("tokens", lambda t: t.isNull())).select(phrase_key, "tokens", F.col("tokens")[0].alias("_token"))
    heads = asked.select("_token", F.size("tokens").alias("n")).limit(most_sent + 1).collect()
    if len(heads) > most_sent:
        longest = asked.agg(F.max(F.size("tokens"))).first()[0]
        reach = lambda token: F.lit(longest)
    else:
        asked = F.broadcast(asked)
        most: dict[str, int] = {}
        for r in heads:
            most[r["_token"]] = max(most.get(r["_token"], 0), r["n"])
        # Lengths up to the next power of two, so that there are few of them.
        alike: dict[int, list[str]] = {}
        for token, n in most.items():
            alike.setdefault(1 << (n - 1).bit_length(), []).append(token)
        reach = lambda token: F.coalesce(F.lit(None).cast("int"), *[F.when(token.isin(own), F.lit(n)) for n, own in alike.items()])
    begun = F.filter(F.transform("_words", lambda x, i: F.struct(x.idx.alias("idx"), F.slice("_words", i + 1, reach(x.token)).alias("next"))), lambda b: b.next.isNotNull())
    each = texts.select(key, F.explode(begun).alias("_b")).select(key, F.col("_b.idx").alias("start_token"), F.col("_b.next").alias("_next"), F.col("_b.next")[0].token.alias("_token"))
    held = F.slice("_next", F.lit(1), F.size("tokens"))
    unbroken = F.element_at(held, -1).idx == F.col("start_token") + F.size("tokens") - 1
    return each.join(asked, "_token").where((F.transform(held, lambda x: x.token) == F.col("tokens")) & unbroken).select(phrase_key, key, "start_token")


def attested(w: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """Labels (one word) that occur in a text as they are or with a plural ending: ``key, label``."""
    forms = labels.where("label IS NOT NULL").select("label", F.explode(F.transform(F.array(F.lit(""), F.lit("s"), F.lit("es")), lambda s: F.concat(F.lower("label"), s))).alias("_form"))
    return w.select(key, F.lower("word").alias("_form")).distinct().join(forms, "_form").select(key, "label").distinct()


def normalized_words(text: str) -> list[str]:
    """Words of a text after compatibility composition, case folding and with plain apostrophes."""
    folded = unicodedata.normalize("NFKC", text).casefold().replace("’", "'")
    out, word = [], ""
    for i, c in enumerate(folded):
        inner = c == "'" and word and i + 1 < len(folded) and folded[i + 1].isalnum()
        if c.isalnum() or inner:
            word += c
        elif word:
            out.append(word)
            word = ""
    return [*out, word] if word else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def normal_words(texts: pd.Series) -> pd.Series:
    """``normalized_words`` over Arrow batches; null gives null."""
    return texts.map(lambda t: None if t is None else normalized_words(t))


def _pieces(texts: list[str | None]) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """Words of all texts and where each text's begin; their pieces with contractions written out, and the word that each comes from."""
    words, first, pieces, owner = [], [0], [], []
    for text in texts:
        for word in normalized_words(text or ""):
            parts = EXPANSIONS.get(word, word).split(" ")
            owner += [len(words)] * len(parts)
            pieces += parts
            words.append(word)
        first.append(len(words))
    return words, np.array(first), pieces, np.array(owner, np.int64)


def aligned(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Word-by-word alignment of two texts of a row: ``key, idx, word, status, right_idx``.

    Both are normalised and contractions written out, and a minimal edit of the pieces tells which stayed. ``exact`` if a word's pieces stayed within
    one equal word, ``normalized`` if they stayed otherwise, else ``unresolved`` with a null ``right_idx``. Null texts have no words.
    Pieces of a whole batch lie in one array, so a word's status comes from minima and maxima over its stretch.
    """
    schema = T.StructType([df.schema[key], *(T.StructField(n, t) for n, t in (("idx", T.IntegerType()), ("word", T.StringType()), ("status", T.StringType()), ("right_idx", T.IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_words, a_first, a_pieces, a_owner = _pieces(batch.column(1).to_pylist())
            b_words, b_first, b_pieces, b_owner = _pieces(batch.column(2).to_pylist())
            stayed = np.full(len(a_pieces), -1, np.int64)
            a_cut, b_cut = np.searchsorted(a_owner, a_first), np.searchsorted(b_owner, b_first)
            for row in range(batch.num_rows):
                edit = difflib.SequenceMatcher(None, a_pieces[a_cut[row] : a_cut[row + 1]], b_pieces[b_cut[row] : b_cut[row + 1]], autojunk=False)
                for kind, i, j, k, _ in edit.get_opcodes():
                    if kind == "equal":
                        stayed[a_cut[row] + i : a_cut[row] + j] = b_owner[b_cut[row] + k : b_cut[row] + k + j - i]
            row_of = np.repeat(np.arange(batch.num_rows), np.diff(a_first))
            status, right_at = np.zeros(0, object), np.zeros(0, np.int64)
            if a_words:
                stretch = np.searchsorted(a_owner, np.arange(len(a_words)))
                least, most = np.minimum.reduceat(stayed, stretch), np.maximum.reduceat(stayed, stretch)
                same = np.array([k >= 0 and a_words[i] == b_words[k] for i, k in enumerate(least.tolist())])
                status = np.where(least < 0, "unresolved", np.where((least == most) & same, "exact", "normalized"))
                right_at = least - b_first[row_of]
            gone = status == "unresolved"
            columns = [batch.column(0).take(pa.array(row_of)), pa.array((np.arange(len(a_words)) - a_first[row_of]).astype(np.int32)), pa.array(a_words, pa.string()), pa.array(status.tolist(), pa.string()), pa.array(right_at.astype(np.int32), mask=np.asarray(gone, bool))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(key, left, right).mapInArrow(run, schema)
