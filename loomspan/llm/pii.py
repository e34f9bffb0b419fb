"""Find personal information in free text and put typed placeholders in its stead.

What the corpus says about its terms decides what counts. Starting from incomplete lists (names, labels of numbers, kinds of streets) the
co-occurrence of a term with a place (next to a name, around a phone or identity number, before a postcode) gives the bits by which the term discloses what stands
there, and terms above a threshold count like those of the lists. Names are two disclosing terms; identity numbers and phone numbers of a form that other numbers have too
need a disclosing term in their sentence; streets of an unlisted kind need a disclosing kind. Forms that nothing else has (email addresses, phone numbers with a
country code or in the usual groups, listed kinds of streets) disclose by themselves. Terms that give away who is meant although the name is gone are generalised last.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.operators.skew import skew_join
from loomspan.session import checkpointed, kept

#: Least pointwise mutual information, in bits, between a term and the place next to a name.
FAMILY_BITS = 4.0
GIVEN_BITS = 2.0
#: Least part of a term's occurrences that stand in such a place.
FAMILY_RATE = 0.05
GIVEN_RATE = 0.002
#: Least number of different names that a new given name stands before.
GIVEN_PARTNERS = 2
#: Greatest part of a name's occurrences that are written in lower case.
MOST_LOWER = 0.3
#: Least information and least part of its occurrences by which a term around numbers discloses them, and least number of these.
CONTEXT_BITS = 5.0
CONTEXT_RATE = 0.25
CONTEXT_LEAST = 5
#: Words before and after a number that are its surroundings, within its sentence.
CONTEXT_WORDS = 6
#: The same for a kind of street before a town with a postcode.
STREET_BITS = 6.0
STREET_RATE = 0.05
STREET_LEAST = 3
#: Least information, part of its occurrences and number of these by which a term discloses a person whose name was taken out.
ENTITY_BITS = 8.0
ENTITY_RATE = 0.5
ENTITY_LEAST = 3
#: A model of at most so many terms goes to the executors as it is; a larger one is joined to the documents that use its terms.
MOST_SENT = 500_000

# Words between a given and a family name.
PARTICLE = r"(?:de la|de los|de las|de|du|des|da|di|del|della|van den|van der|van de|van|von der|von dem|von|zu|ter|le|la|bin|al|el|y)"
# Nouns after which a name is that of a place or house.
PLACE = {
    "lane", "street", "road", "avenue", "close", "terrace", "drive", "court", "way", "square", "crescent", "row", "gardens", "grove", "park", "institute", "house",
    "hall", "harbour", "bridge", "school", "college", "university", "hospital", "library", "museum", "theatre", "church", "abbey", "cottage", "manor", "lodge",
    "farm", "mill", "tower", "inn", "hotel", "station", "centre", "center", "building", "hill", "river", "lake", "island", "valley", "wood", "woods", "foundation", "family",
}

_GAP = r"[ \t   ]"
_LETTER = r"[^\W\d_][\u0300-\u036f]*"
_WORD = re.compile(rf"(?:{_LETTER})+")
_ASCII_WORD = re.compile("[A-Za-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")
# A word of the running text, not of an address or a file name.
_TERM = re.compile(rf"(?<![\w@.+/-])(?:{_LETTER}){{2,}}(?![\w@+]|[./]\w)|(?<=\w-)(?:{_LETTER}){{2,}}(?![\w@+-]|[./]\w)")
_PAIR = re.compile(rf"(?![a-z])(?<![\w@.+'’-])((?:{_LETTER}){{2,}})(?=({_GAP}(?:[^\W\d_]\.{_GAP}){{0,2}}(?:{PARTICLE}{_GAP})?)((?:{_LETTER}){{2,}})(?![\w@+]|[./]\w))")
_INVERTED = re.compile(rf"(?:-(?:{_LETTER})+)?,{_GAP}([^\W\d_])")

# Characters drawn wider or otherwise than the plain ones, one for one, so that places in the text stay.
_FOLD = {0xFF01 + i: chr(0x21 + i) for i in range(94)} | {ord(c): "-" for c in "‐‑‒–−﹣"} | {ord(c): " " for c in "        　"}



@lru_cache(maxsize=1)
def _plain_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for point, to in _FOLD.items():
        table[point] = ord(to)
    return table


def plain_form(text: str) -> str:
    """The text with wide and unusual digits, dashes and spaces as plain ones, place for place."""
    if text.isascii():
        return text
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _plain_table()[points].tobytes().decode("utf-32-le", "surrogatepass")


# Digits in words.
SPELLED = ("zero", "oh", "nought", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_DIGIT_WORD = "(?:" + "|".join(SPELLED) + ")"
_PHONE = re.compile(
    r"(?=[+(\d])(?<![\w@.:/+-])(?<!\d )(?:"
    r"(?:\+?1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"  # three, three and four digits
    r"|(?:\+44 ?\(?0?\)?|0)7\d{3} ?\d{3} ?\d{3}"  # mobile, eleven digits
    r"|(?:\+44 ?\(?0?\)?|0)(?:2\d ?\d{4} ?\d{4}|1\d{2,3} ?\d{3} ?\d{3,4})"  # landline with area code
    r"|(?:\+33 ?|0)[1-9](?:[ .-]?\d{2}){4}"  # pairs of digits
    r"|\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}"  # any other with a country code
    r")(?![\w@]|[-.:/]\d)"
)
_SPELLED = re.compile(
    rf"(?=[pzontfse])(?<![\w-])(?:(?:plus )?{_DIGIT_WORD}(?:[ -]+{_DIGIT_WORD}){{6,14}})(?![\w-])",
    re.I,
)
# Forms that other numbers have too; they need a disclosing term in their sentence.
_WEAK_PHONE = re.compile(
    r"(?=[(\d])(?<![\w@.:/+-])(?<!\d )(?:"
    r"\(0\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,5}"  # area code in brackets
    r"|0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,5}|0\d{9,10}"  # area code behind a zero
    r")(?![\w@]|[-.:/]\d)"
)
# Words by which a number is known to be one to call.
PHONE_LABELS = {"phone", "telephone", "tel", "mobile", "cell", "fax", "call", "dial", "ring", "telefon", "handy", "telefono", "teléfono", "móvil", "llamar", "llame", "téléphone", "telephone", "portable", "appeler", "appelez", "anrufen", "rufnummer"}

# What may stand between the two parts of an address; the pattern below is tried only before these.
_AT = re.compile(r" ?@ ?(?=[^\W\d_])| ?[\[({<] ?at ?[\])}>]| at (?=[\w-]+ dot )", re.I)
_EMAIL = re.compile(
    r"(?<![\w.+%-])[\w%+-]+(?:\.[\w%+-]+)*(?:"
    r" ?[@] ?| ?[\[({<] ?at ?[\])}>] ?| at (?=[\w-]+(?: dot [\w-]+)+)"
    r")[^\W\d_][\w-]*(?:(?:\.| ?[\[({<] ?dot ?[\])}>] ?| dot )[^\W_][\w-]*)*(?:\.| ?[\[({<] ?dot ?[\])}>] ?| dot )[^\W\d_]{2,}(?![\w@])",
    re.I,
)

# The label that each form of number must have near it; the number stands without its label.
_ID_FORMS = {
    r"\d{3}([ -]?)\d{2}\1\d{4}": r"\bssn\b|social security|sozialversicherung|seguridad social|s[ée]curit[ée] sociale",
    r"[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-z]": r"national insurance|\bni (?:number|no\b)|\bnino\b",
    r"[a-z]{1,2}\d{6,9}": r"passport|pasaporte|passeport|reisepass",
    r"[a-z]\d{3}-\d{4}-\d{4}|[a-z]{5}\d{6}[a-z0-9]{5}": r"driv(?:ing|er'?s?) licen[cs]e|f[üu]hrerschein|permis de conduire|permiso de conducir",
}
_IDS = [(re.compile(rf"(?<![\w./:-])(?:{form})(?![\w]|[-/:]\d)", re.I), re.compile(label, re.I)) for form, label in _ID_FORMS.items()]
#: Characters before and after an identity number in which its label may stand even if a sentence ends between them.
_ID_BEFORE, _ID_AFTER = 60, 48
# Parts of the labels above, one group for each form.
_ID_PARTS = (("ssn", "social sec", "sozialvers", "seguridad", "curit"), ("national ins", "ni n", "nino"), ("passport", "pasaporte", "passeport", "reisepass"), ("licen", "hrerschein", "permis"))
# The end of a line or sentence; not the point of an abbreviation before a number.
_STOP = re.compile(r"(?=[\n.!?])(?:\n|(?<!\b[Nn]o)(?<!\b[Nn]r)(?<!\b[Nn]um)(?<!\b[Nn]úm)(?<!\b[Tt]el)(?<!\b[Ss]t)(?<!\b[A-Z])[.!?][\"'”’)\]]*[ \u00a0]+(?=[^\W\d_a-zß-öø-ÿ]))")

# Kinds of streets.
STREETS = (
    "Street", "St.", "Road", "Lane", "Avenue", "Close", "Terrace", "Drive", "Court", "Way", "Place", "Crescent", "Square", "Gardens", "Grove", "Boulevard",
    "Rise", "Parkway", "Walk", "Mews", "Row", "Hill", "Highway", "Circle", "Trail", "Quay", "Wharf", "Yard", "Vale", "Alley", "Parade", "Embankment",
)
_SHORT_STREET = r"(?:St|Rd|Ln|Ave|Dr|Ct|Blvd|Pkwy|Hwy|Cres|Sq)\b(?:\.(?=[.,;:)]| [a-z0-9]))?"
_STREET_KIND = "(?:" + "|".join(re.escape(k) for k in STREETS) + f"|{_SHORT_STREET})(?![^\\W\\d_])"
_NAME = r"[^\W\d_a-zß-öø-ÿ][^\W\d_'’]+(?:[ '’-][^\W\d_a-zß-öø-ÿ][^\W\d_]+)?"
_TOWN = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]+(?:[ -][^\W\d_a-zß-öø-ÿ][^\W\d_]+)?(?!\w)"
_POSTCODE = r"[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}(?!\w)"
_NUMBER = r"\d{1,5}(?: ?[A-Za-z](?![\w]))?"
_FLAT_BEHIND = r"(?:, (?:Apt\.?|Flat|Unit|Apartment|#) ?\d+[A-Za-z]?)?"
_WITH_POSTCODE = rf",?[ \n](?:{_POSTCODE}|{_TOWN},? (?:[A-Z]{{1,2}} )?\d{{5}}(?:-\d{{4}})?(?!\w)|{_TOWN},?[ \n]{_POSTCODE})"


def _numbered_street(kind: str) -> str:
    """Flat and house number before a street; then a flat, and a town with its postcode, or without one behind a comma."""
    return rf"(?:(?P<flat>Flat|Unit|Apartment|Apt\.?) ?\d+[A-Za-z]?,[ \n])?\d{{1,5}}[A-Za-z]? {_NAME} {kind}{_FLAT_BEHIND}(?:{_WITH_POSTCODE}|,[ \n](?P<town>{_TOWN}))?"


_ADDRESS = re.compile(
    rf"(?=[^\W_a-zß-öø-ÿ])(?<![\w./:-])(?:{_numbered_street(_STREET_KIND)}"
    # house number before a street whose kind comes first
    rf"|\d{{1,5}}[A-Za-z]?,? (?:rue|avenue|boulevard|chemin|allée|quai|place|impasse|cours|route)(?: de la| de l['’]| des| du| de)? {_NAME}(?:,[ \n]\d{{4,5}} {_TOWN})?"
    # the number behind: kind in the name, or before it
    rf"|[^\W\d_a-zß-öø-ÿ][^\W\d_]+(?:straße|strasse|gasse|weg|platz|allee|ring|damm) {_NUMBER}(?:,[ \n]\d{{4,5}} {_TOWN})?"
    rf"|(?:Calle|Plaza|Avenida|Paseo|Camino|Carrera|Via|Viale|Piazza|Corso)(?: de la| del| de los| de)? {_NAME},? {_NUMBER}(?:,[ \n]\d{{4,5}} {_TOWN})?"
    r")"
)
_ANY_KIND = r"(?P<kind>[^\W\d_a-zß-öø-ÿ][^\W\d_]+)"
# A street of a kind that the corpus taught, and what teaches it: a kind before a town with a postcode.
_OTHER_ADDRESS = re.compile(rf"(?=[^\W_a-zß-öø-ÿ])(?<![\w./:-]){_numbered_street(_ANY_KIND)}")
_POSTED = re.compile(rf"(?=\d)(?<![\w./:-])\d{{1,5}}[A-Za-z]? (?:[^\W\d_a-zß-öø-ÿ][^\W\d_'’]+[ '’-]){{1,2}}{_ANY_KIND}{_FLAT_BEHIND}{_WITH_POSTCODE}")
_DIGIT = re.compile(r"\d")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())]))
# What is written in the place of each kind.
PLACEHOLDER = {"term": "[TERM]", "person_name": "[PERSON_NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[IDENTITY_NUMBER]", "street_address": "[STREET_ADDRESS]"}


#: What a term of the model discloses, as bits of a number. ``id0`` to ``id3`` are the forms of identity numbers.
ROLES = {"given": 1, "family": 2, "phone": 4, "street": 8, "id0": 16, "id1": 32, "id2": 64, "id3": 128}


def fold(term: str) -> str:
    """A term as it is compared: composed and case-folded."""
    return (term if term.isascii() else unicodedata.normalize("NFC", term)).lower()


# --- what the corpus says about its terms ---------------------------------------------------------------------------


#: What a token may lead to, besides the bits of ROLES.
_HAS_DIGIT, _HAS_AT, _HAS_SPELLED, _HAS_STREET, _HAS_LABEL, _HAS_PHONE_LABEL, _HAS_GROUP, _HAS_POSTCODE = (1 << k for k in range(20, 28))
_STREET_WORDS = {k.rstrip(".") for k in STREETS} | {"Rd", "Ln", "Ave", "Dr", "Ct", "Blvd", "Pkwy", "Hwy", "Cres", "Sq", "rue", "avenue", "boulevard", "chemin", "allée", "quai", "place", "impasse", "cours", "route", "Calle", "Plaza", "Avenida", "Paseo", "Camino", "Carrera", "Via", "Viale", "Piazza", "Corso"}
_STREET_ENDS = ("straße", "strasse", "gasse", "weg", "platz", "allee", "ring", "damm")
_LABEL_PARTS = ("ssn", "social", "sozialvers", "seguridad", "curit", "national", "ni", "nino", "passport", "pasaporte", "passeport", "reisepass", "licen", "hrerschein", "permis")
_AT_PART = re.compile(r"@|[\[({<](?:at|$)|dot", re.I)
# A token that a phone number may begin with or hold.
_GROUP_PART = re.compile(r"\+\d|\d{3}|^\W*0\d")
_POSTCODE_PART = re.compile(r"\d{5}|^[A-Z]{1,2}\d[A-Z\d]?$")


class _Tokens(dict):
    """What the signs between two spaces may lead to; each different token is looked at once for a model.

    No pattern below finds anything in a text none of whose tokens leads to it, so most texts meet few patterns.
    """

    def __init__(self, roles: dict[str, int]) -> None:
        super().__init__()
        self.roles = roles

    def __missing__(self, token: str) -> int:
        plain = plain_form(token)
        lower = plain.lower()
        found = 0
        for word in {*_WORD.findall(fold(token)), *_WORD.findall(fold(plain))}:
            found |= self.roles.get(word, 0)
            found |= _HAS_PHONE_LABEL if word in PHONE_LABELS else 0
        words = _WORD.findall(plain)
        found |= _HAS_STREET if any(w in _STREET_WORDS or w.endswith(_STREET_ENDS) for w in words) else 0
        found |= _HAS_SPELLED if any(w in lower for w in SPELLED) else 0
        found |= _HAS_LABEL if any(w in lower for w in _LABEL_PARTS) else 0
        found |= _HAS_AT if _AT_PART.search(plain) else 0
        if _DIGIT.search(plain):
            found |= _HAS_DIGIT | (_HAS_GROUP if _GROUP_PART.search(plain) else 0) | (_HAS_POSTCODE if _POSTCODE_PART.search(plain) else 0)
        if len(self) > 1_000_000:
            self.clear()
        self[token] = found
        return found

    def of(self, tokens: list[str]) -> int:
        return reduce(or_, map(self.__getitem__, tokens), 0)


class _Words(dict):
    """Roles of words as they are written; each is folded once for a model."""

    def __init__(self, roles: dict[str, int]) -> None:
        super().__init__()
        self.roles = roles

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = found = self.roles.get(fold(word), 0)
        return found


def _composed(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


class _Sentences:
    """Sentences and lines of a text, cut once when first asked for."""

    def __init__(self, text: str) -> None:
        self.text, self.stops = text, None

    def around(self, start: int, end: int) -> tuple[int, int]:
        """Begin and end of what holds a stretch."""
        if self.stops is None:
            self.stops = [m.end() for m in _STOP.finditer(self.text)]
        at, to = bisect_right(self.stops, start), bisect_left(self.stops, end)
        return self.stops[at - 1] if at else 0, self.stops[to] if to < len(self.stops) else len(self.text)

    def terms(self, start: int, end: int, words: int | None = None) -> set[str]:
        """Folded words around a stretch in its sentence, so many on each side, or all."""
        low, high = self.around(start, end)
        before, after = _TERM.findall(_composed(self.text[low:start])), _TERM.findall(_composed(self.text[end:high]))
        return {w.lower() for w in (before + after if words is None else before[-words:] + after[:words])}


def _labelled_ids(text: str, sentences: _Sentences) -> Iterator[tuple[int, int, int, bool]]:
    """Numbers of an identity form whose label may be in the text: form, begin, end, and whether the label is near or in the sentence."""
    lower = text.lower()
    for i, (form, label) in enumerate(_IDS):
        if any(part in lower for part in _ID_PARTS[i]):
            for m in form.finditer(text):
                low, high = sentences.around(m.start(), m.end())
                before, after = text[min(low, max(0, m.start() - _ID_BEFORE)) : m.start()], text[m.end() : max(high, m.end() + _ID_AFTER)]
                yield i, m.start(), m.end(), bool(label.search(_composed(before)) or label.search(_composed(after)))


def _phones(text: str) -> Iterator[tuple[int, int]]:
    """Phone numbers whose form discloses them."""
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.start(), m.end()


def _surroundings(value: str, leads: int) -> Iterator[tuple[str, str]]:
    """What a text tells of terms around numbers: (term, role of which it stands in the place)."""
    plain = plain_form(value)
    sentences = _Sentences(plain)
    if leads & _HAS_GROUP:
        for start, end in _phones(plain):
            for term in sentences.terms(start, end, CONTEXT_WORDS):
                yield term, "phone"
    if leads & _HAS_LABEL:
        for i, start, end, known in _labelled_ids(plain, sentences):
            if known:
                for term in sentences.terms(start, end, CONTEXT_WORDS):
                    yield term, f"id{i}"
    if leads & _HAS_POSTCODE:
        for m in _POSTED.finditer(plain):
            if m.group("kind") not in STREETS:
                yield fold(m.group("kind")), "street"


def _neighbours(documents: DataFrame, text: str) -> DataFrame:
    """Counts over the corpus: terms (``a`` alone), capital neighbours (``a`` then ``b``) and terms in the place of a ``role``.

    ``part`` of a term's are those in lower case, of neighbours' those with nothing but a space between.
    """
    names = ["a", "b", "role", "n", "part"]
    schema = T.StructType([T.StructField(c, T.StringType() if c in ("a", "b", "role") else T.LongType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Tokens({})
        for batch in batches:
            tokens: Counter = Counter()
            placed: Counter = Counter()
            pairs: dict[tuple[str, str], list[int]] = {}
            for value in batch.column(0).to_pylist():
                if not value:
                    continue
                held = value.split()
                tokens.update(held)
                if (leads := known.of(held)) & _HAS_DIGIT:
                    placed.update(_surroundings(value, leads))
                for found in _PAIR.finditer(value):
                    a, gap, b = found.groups()
                    if a[0].isupper() and b[0].isupper():
                        after = _INVERTED.match(value, found.end(3))
                        if after is None or not after.group(1).isupper():
                            entry = pairs.setdefault((fold(a), fold(b)), [0, 0])
                            entry[0] += 1
                            entry[1] += len(gap) == 1
            # What makes a word a term lies within the signs between two spaces, so each different token is looked at once.
            folded: dict[str, list[int]] = {}
            for token, n in tokens.items():
                for term in _TERM.findall(token):
                    entry = folded.setdefault(fold(term), [0, 0])
                    entry[0] += n
                    entry[1] += n if term[0].islower() else 0
            rows = [(t, None, None, n, low) for t, (n, low) in folded.items()] + [(a, b, None, n, direct) for (a, b), (n, direct) in pairs.items()]
            rows += [(t, None, role, n, 0) for (t, role), n in placed.items()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            kinds = [pa.string()] * 3 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    counted = documents.select(F.col(text)).mapInArrow(run, schema)
    return counted.groupBy("a", "b", "role").agg(F.sum("n").alias("n"), F.sum("part").alias("part"))


def _disclosing(slots: DataFrame, terms: DataFrame, total: int, bits: float, rate: float, partners: int = 1) -> DataFrame:
    """Terms whose place tells enough: ``term, n_slot, n, bits``.

    ``slots``: ``term, partner, n``. The measure is the pointwise mutual information of the term and the place:
    log2 of P(term | place) / P(term).
    """
    by_term = slots.groupBy("term").agg(F.sum("n").alias("n_slot"), F.count("*").alias("partners"))
    all_slots = float(slots.agg(F.sum("n")).first()[0] or 1)
    scored = by_term.join(terms, "term").withColumn("bits", F.log2(F.col("n_slot") * F.lit(total / all_slots) / F.col("n")))
    enough = (F.col("bits") >= bits) & (F.col("n_slot") >= rate * F.col("n")) & (F.col("partners") >= partners)
    return scored.where(enough & (F.col("lower") <= MOST_LOWER * F.col("n") + 2)).select("term", "n_slot", "n", "bits")


def name_terms(documents: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Terms that disclose: ``term, role, bits``; terms are composed and lower-case, roles those of ROLES.

    All counts are over all documents. Family names are terms that follow known given names, new given names are
    terms that come before those, and family names are then taken once more with these. Known names are in without a measure (null bits)
    where the corpus has none for them.
    """
    # Every step is written before the next, so that none is planned or run more than once.
    counted = checkpointed(_neighbours(documents, text))
    terms = counted.where("b IS NULL AND role IS NULL").select(F.col("a").alias("term"), "n", F.col("part").alias("lower"))
    pairs = counted.where("b IS NOT NULL").select("a", "b", "n", F.col("part").alias("direct"))
    total = terms.agg(F.sum("n")).first()[0] or 1
    listed = known.where(F.col("name").isNotNull()).select(F.lower("name").alias("term"), "role").distinct()
    given = listed.where("role = 'given'").select("term")

    def families(given: DataFrame) -> DataFrame:
        after = pairs.join(given.select(F.col("term").alias("a")), "a").select(F.col("b").alias("term"), F.col("a").alias("partner"), "n")
        return _disclosing(after, terms, total, FAMILY_BITS, FAMILY_RATE).join(given, "term", "left_anti")

    first = checkpointed(families(given))
    # A title or another word before an initial is no given name, so only direct neighbours count here.
    before = pairs.where("direct > 0").join(first.select(F.col("term").alias("b")), "b").select(F.col("a").alias("term"), F.col("b").alias("partner"), F.col("direct").alias("n"))
    new = checkpointed(_disclosing(before, terms, total, GIVEN_BITS, GIVEN_RATE, GIVEN_PARTNERS).join(first.select("term"), "term", "left_anti"))
    second = families(given.unionByName(new.select("term")).distinct())
    learned = new.select("term", F.lit("given").alias("role"), "bits").unionByName(second.select("term", F.lit("family").alias("role"), "bits"))
    names = learned.select("term").union(listed.select("term")).distinct()
    around = checkpointed(counted.where("role IS NOT NULL").join(names.withColumnRenamed("term", "a"), "a", "left_anti").select(F.col("a").alias("term"), "n", "role"))
    bounds = {role: (STREET_BITS, STREET_RATE, STREET_LEAST) if role == "street" else (CONTEXT_BITS, CONTEXT_RATE, CONTEXT_LEAST) for role in ROLES if role not in ("given", "family")}
    bound = lambda k: F.try_element_at(F.create_map(*[F.lit(x) for role, b in bounds.items() for x in (role, float(b[k]))]), F.col("role"))
    everywhere = around.groupBy("role").agg(F.sum("n").alias("_slots"))
    scored = around.join(F.broadcast(everywhere), "role").join(terms.withColumnRenamed("n", "n_term"), "term").withColumn("bits", F.log2(F.col("n") * F.lit(float(total)) / F.col("_slots") / F.col("n_term")))
    found = scored.where((F.col("bits") >= bound(0)) & (F.col("n") >= bound(1) * F.col("n_term")) & (F.col("n") >= bound(2)))
    learned = learned.unionByName(found.select("term", "role", "bits"))
    return checkpointed(learned.unionByName(listed.withColumn("bits", F.lit(None).cast("double"))).groupBy("term", "role").agg(F.max("bits").alias("bits")))


# --- finding -------------------------------------------------------------------------------------------------------


def _looked_up(text: str) -> set[str]:
    """All terms whose roles are asked for: the words of the folded text, the folded words, and those of streets, which end before a combining mark."""
    plain = plain_form(text)
    return {w for t in (text, plain) for w in (*_WORD.findall(fold(t)), *map(fold, set(_WORD.findall(t))))} | set(map(fold, _LETTERS.findall(plain)))


def _person_names(text: str, roles: _Words, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Spans of a given name or its initial together with a family name. ``roles``: 1 given, 2 family, 3 both."""
    words = [(*m.span(), roles[m.group()]) for m in (_ASCII_WORD if text.isascii() else _WORD).finditer(text)]
    found: list[tuple[str, int, int]] = []
    i, n = 0, len(words)

    def joined(a: int, b: int, allowed: str) -> bool:
        return text[words[a][1] : words[b][0]] in allowed.split("|")

    def is_initial(k: int) -> bool:
        s, e, _ = words[k]
        return e - s == 1 and text[s].isupper() and text[e : e + 1] == "."

    def family_end(k: int) -> int:
        """Last word of the family name that begins at k, or -1."""
        if k >= n or not words[k][2] & 2:
            return -1
        while k + 1 < n and text[words[k][1] : words[k + 1][0]] == "-" and words[k + 1][2] & 2:
            k += 1
        return k

    def after_given(k: int) -> int:
        """Last word of the family name that follows the given name or initial at k, or -1."""
        gap = "|".join([" ", " ", " ", " ", "\t", "  "])
        dotted = "|".join(["." + g for g in gap.split("|")] + ["."])
        j = k
        for _ in range(3):
            sep = dotted if is_initial(j) else gap
            if j + 1 >= n or not joined(j, j + 1, sep):
                return -1
            j += 1
            if not is_initial(j):
                break
        last = family_end(j)
        if last >= 0:
            return last
        particle = re.compile(rf"{PARTICLE}{_GAP}+", re.I).match(text, words[j][0])
        if particle is None:
            return -1
        while j < n and words[j][0] < particle.end():
            j += 1
        return family_end(j) if j < n and words[j][0] == particle.end() else -1

    inside = iter(sorted(taken))
    span = next(inside, None)
    while i < n:
        start, end, role = words[i]
        if not role & 3 and end - start > 1:
            i += 1
            continue
        while span is not None and span[1] <= start:
            span = next(inside, None)
        if span is not None and span[0] < end:
            i += 1
            continue
        before, after = text[start - 1 : start], text[end : end + 1]
        last = -1
        if (role & 1 or is_initial(i)) and before not in ("@", "-", "_", "+", "."):
            last = after_given(i)
        stop = words[last][1] if last >= 0 else -1
        if last < 0 and role & 2 and before not in ("@", "-", "_", "+", "."):
            # family name, comma, given name with initials
            k = family_end(i)
            if k + 1 < n and text[words[k][1] : words[k + 1][0]] in (", ", ", ") and (words[k + 1][2] & 1 or is_initial(k + 1)):
                last, stop = k + 1, words[k + 1][1] + (1 if is_initial(k + 1) else 0)
                if is_initial(k + 1) and k + 2 < n and joined(k + 1, k + 2, ". ") and words[k + 2][2] & 2:
                    last = -1  # the initial belongs to the name that follows
                if last >= 0 and words[last][2] & 1:
                    if after_given(last) >= 0:
                        last = -1  # so does the given name
                    else:
                        while last + 1 < n and is_initial(last + 1) and text[words[last][1] : words[last + 1][0]] in (" ", ". "):
                            last += 1
                            stop = words[last][1] + 1
        if last >= 0:
            follows = words[last + 1] if last + 1 < n else None
            place = follows is not None and text[words[last][1] : follows[0]] in (" ", " ") and text[follows[0] : follows[1]].casefold() in PLACE
            if not place and text[stop : stop + 1] not in ("@", "_", "+") and not (span is not None and span[0] < stop):
                found.append(("person_name", start, stop))
                i = last + 1
                continue
        i += 1
    return found


def find_spans(text: str, roles: dict[str, int], tokens: _Tokens | None = None, words: _Words | None = None) -> list[tuple[str, int, int]]:
    """All personal information in a text: (kind, start, end) in code points, in order, not overlapping.

    ``roles`` are those of the model's terms; ``tokens`` and ``words``, made from the same roles, keep what was looked up for other texts.
    """
    leads = (_Tokens(roles) if tokens is None else tokens).of(text.split())
    found: list[tuple[str, int, int]] = []
    plain = plain_form(text) if leads & (_HAS_AT | _HAS_DIGIT | _HAS_SPELLED) else text
    if leads & _HAS_AT:
        found += _emails(plain)
    if leads & _HAS_DIGIT:
        found += _numbers(plain, roles, leads)
    if leads & _HAS_SPELLED and sum(map(text.lower().count, SPELLED)) > 6:
        found += [("phone", m.start(), m.end()) for m in _SPELLED.finditer(plain)]
    found = _apart(found)
    if leads & 2:
        found += _person_names(text, _Words(roles) if words is None else words, [(s, e) for _, s, e in found])
    return sorted(found, key=lambda x: x[1])


def _numbers(plain: str, roles: dict[str, int], leads: int) -> list[tuple[str, int, int]]:
    """Addresses, identity numbers and phone numbers."""
    found = [("street_address", m.start(), _address_end(plain, m)) for m in _ADDRESS.finditer(plain)] if leads & _HAS_STREET else []
    if leads & ROLES["street"]:
        found += [("street_address", m.start(), _address_end(plain, m)) for m in _OTHER_ADDRESS.finditer(plain) if roles.get(fold(m.group("kind")), 0) & ROLES["street"]]
    sentences = _Sentences(plain)
    discloses = lambda start, end, bit: any(roles.get(term, 0) & bit for term in sentences.terms(start, end))
    seen = set()
    for i, start, end, known in _labelled_ids(plain, sentences) if leads & _HAS_LABEL else ():
        seen.add((i, start))
        if known or discloses(start, end, ROLES[f"id{i}"]):
            found.append(("identity_number", start, end))
    for i, (form, _) in enumerate(_IDS):
        if leads & ROLES[f"id{i}"]:
            found += [("identity_number", m.start(), m.end()) for m in form.finditer(plain) if (i, m.start()) not in seen and discloses(m.start(), m.end(), ROLES[f"id{i}"])]
    if not leads & _HAS_GROUP:
        return found
    found += [("phone", start, end) for start, end in _phones(plain)]
    if not leads & (_HAS_PHONE_LABEL | ROLES["phone"]):
        return found
    taken = [(s, e) for _, s, e in found]
    for m in _WEAK_PHONE.finditer(plain):
        if 7 <= sum(c.isdigit() for c in m.group()) <= 15 and not any(s < m.end() and m.start() < e for s, e in taken):
            terms = sentences.terms(m.start(), m.end())
            if terms & PHONE_LABELS or any(roles.get(term, 0) & ROLES["phone"] for term in terms):
                found.append(("phone", m.start(), m.end()))
    return found


def _emails(text: str) -> list[tuple[str, int, int]]:
    """Addresses, looked for from the sign between their parts: back over the local part, then forward by the pattern."""
    found: list[tuple[str, int, int]] = []
    for at in _AT.finditer(text):
        start = at.start()
        while start and (text[start - 1].isalnum() or text[start - 1] in "_%+-."):
            start -= 1
        while text[start] == ".":
            start += 1
        m = _EMAIL.match(text, start) if start < at.start() else None
        if m and m.end() > at.end() and (not found or m.start() >= found[-1][2]):
            found.append(("email", m.start(), m.end()))
    return found


def _address_end(text: str, m: re.Match) -> int:
    """End of an address; in one without flat and postcode a capital word behind its comma is a town only if it ends the clause."""
    if not m.group("town") or m.group("flat"):
        return m.end()
    rest = text[m.end("town") : m.end("town") + 2]
    return m.end() if not rest.strip() or rest[0] in ".,;:!?)\n" or rest[0] == " " else m.start("town") - 2


def _apart(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans without overlap: the earliest first, of those that begin together the longest."""
    out: list[tuple[str, int, int]] = []
    for span in sorted(spans, key=lambda x: (x[1], -x[2])):
        if not out or span[1] >= out[-1][2]:
            out.append(span)
    return out


def _family(text: str, span: tuple[str, int, int], roles: _Words) -> str | None:
    """The folded family name of a person's span: its last word that is one."""
    kind, start, end = span
    own = [w for w in _WORD.findall(text[start:end]) if roles[w] & ROLES["family"]] if kind == "person_name" else []
    return fold(own[-1]) if own else None


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with placeholders; all else stays as it is."""
    parts, at = [], 0
    for kind, start, end in spans:
        parts += [text[at:start], PLACEHOLDER[kind]]
        at = end
    return "".join([*parts, text[at:]])


def _role_map(rows: Iterator[tuple[str, str]]) -> dict[str, int]:
    roles: dict[str, int] = {}
    for term, role in rows:
        roles[term] = roles.get(term, 0) | ROLES.get(role, ROLES["family"])
    return roles


def with_spans(documents: DataFrame, model: DataFrame, keep: list[str], text: str = "text", clean: str | None = None, most_sent: int | None = None, families: str | None = None) -> DataFrame:
    """Add ``spans``, all personal information in the text, and drop the text; with ``clean`` also the redacted text.

    ``model`` as ``name_terms`` gives it. Up to ``most_sent`` terms (MOST_SENT if null) go to the executors as a broadcast variable; of a
    larger model each document gets only the terms it holds, by a join, so no model is too large. With ``families`` also the folded family name
    of each span, null where it has none.

    Defined cases: null text gives null spans and null redaction, empty text empty ones; texts are taken whole; repeated rows give the same again.
    """
    schema = T.StructType([*(documents.schema[c] for c in keep), T.StructField("spans", SPANS), *([T.StructField(clean, T.StringType())] if clean else []), *([T.StructField(families, T.ArrayType(T.StringType()))] if families else [])])
    most_sent = MOST_SENT if most_sent is None else most_sent
    sample = model.select("term", "role").limit(most_sent + 1).collect()
    if len(sample) <= most_sent:
        sent = documents.sparkSession.sparkContext.broadcast(_role_map((r["term"], r["role"]) for r in sample))
        source = documents.select(*keep, F.col(text).alias("_text"), F.lit(None).cast("array<struct<term:string,role:string>>").alias("_terms"))
    else:
        sent = None
        source = _with_own_terms(documents, model, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roles = {} if sent is None else sent.value
        tokens, words = _Tokens(roles), _Words(roles)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text")).to_pylist()
            own = batch.column(batch.schema.get_field_index("_terms")).to_pylist() if sent is None else None
            flat, ends, cleaned, named = [], [0], [], []
            for i, value in enumerate(texts):
                if own is not None:
                    roles = _role_map((t["term"], t["role"]) for t in own[i] or ())
                    tokens, words = _Tokens(roles), _Words(roles)
                found = [] if value is None else find_spans(value, roles, tokens, words)
                flat += found
                ends.append(len(flat))
                if clean:
                    cleaned.append(None if value is None else redact(value, found))
                if families:
                    named += [_family(value, span, words) for span in found]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            kinds, starts, stops = zip(*flat, strict=True) if flat else ((), (), ())
            parts = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=["kind", "char_start", "char_end"])
            null = pa.array([value is None for value in texts], pa.bool_())
            columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts, mask=null), *([pa.array(cleaned, pa.string())] if clean else [])]
            columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(named, pa.string()), mask=null)] if families else []
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def _with_own_terms(documents: DataFrame, model: DataFrame, keep: list[str], text: str) -> DataFrame:
    numbered = kept(documents.select(*keep, F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms = [], []
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _looked_up(value or "")
                rows += [row] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(terms, pa.string())], names=["_row", "term"])

    used = numbered.select("_row", "_text").mapInArrow(run, "_row bigint, term string")
    own = used.join(model.select("term", "role"), "term").groupBy("_row").agg(F.collect_list(F.struct("term", "role")).alias("_terms"))
    return numbered.join(own, "_row", "left").drop("_row")


def found_rows(spanned: DataFrame, key: str) -> DataFrame:
    """One row per finding: ``<key>, kind, char_start, char_end``."""
    each = spanned.select(key, F.explode("spans").alias("s"))
    return each.select(key, "s.kind", "s.char_start", "s.char_end")



# --- terms that give away whose name was taken out -------------------------------------------------------------------


def _company(text: str, spans: list[dict], families: list[str | None]) -> Iterator[tuple[str, str]]:
    """Persons of a text with the terms of their sentences: (folded family name, term). Terms inside findings are left out. ``families``: one for each span."""
    persons = [(s, family) for s, family in zip(spans, families, strict=True) if family is not None]
    if not persons:
        return
    blank = list(text)
    for s in spans:
        blank[s["char_start"] : s["char_end"]] = " " * (s["char_end"] - s["char_start"])
    sentences = _Sentences("".join(blank))
    for s, family in persons:
        for term in sentences.terms(s["char_start"], s["char_end"]):
            yield family, term


def disclosing_terms(documents: DataFrame, model: DataFrame, text: str = "text") -> DataFrame:
    """Terms that tell of a person although the name is taken out: ``entity, term, n, bits``; ``entity`` is the folded family name.

    The measure is the pointwise mutual information of a term and the sentences that name the person, over all documents. A term counts if it tells at
    least ENTITY_BITS, stands with that person in ENTITY_RATE of its occurrences, and does so ENTITY_LEAST times.
    """
    found = checkpointed(_met(documents, model, text))
    terms = found.where("entity IS NULL").groupBy("term").agg(F.sum("n").alias("n_term"))
    pairs = found.where("entity IS NOT NULL").groupBy("entity", "term").agg(F.sum("n").alias("n"))
    company = pairs.groupBy("entity").agg(F.sum("n").alias("n_entity"))
    total = terms.agg(F.sum("n_term")).first()[0] or 1
    scored = skew_join(pairs, company, ["entity"]).join(terms, "term").withColumn("bits", F.log2(F.col("n") * F.lit(float(total)) / F.col("n_entity") / F.col("n_term")))
    return scored.where((F.col("bits") >= ENTITY_BITS) & (F.col("n") >= ENTITY_LEAST) & (F.col("n") >= ENTITY_RATE * F.col("n_term"))).select("entity", "term", "n", "bits")


def _met(documents: DataFrame, model: DataFrame, text: str, key: str | None = None) -> DataFrame:
    """Persons and terms that meet: ``entity, term, n`` with terms alone (null entity), or with ``key`` each document's distinct ``entity, term``."""
    held = [key] if key else []
    rows = with_spans(documents.select(*held, F.col(text).alias("_whole"), F.col(text).alias("_text")), model, [*held, "_whole"], "_text", families="_families")
    out = T.StructType([*([documents.schema[key]] if key else []), T.StructField("entity", T.StringType()), T.StructField("term", T.StringType()), *([] if key else [T.StructField("n", T.LongType())])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, families = (batch.column(len(held) + i).to_pylist() for i in range(3))
            index, pairs, tokens, counted = [], [], Counter(), Counter()
            for row, (value, found, named) in enumerate(zip(texts, spans, families, strict=True)):
                if not value:
                    continue
                met = list(_company(value, found, named))
                if key:
                    own = sorted(set(met))
                    index += [row] * len(own)
                    pairs += own
                else:
                    tokens.update(value.split())
                    counted.update(met)
            if key:
                columns = [batch.column(0).take(pa.array(index, pa.int64())), pa.array([e for e, _ in pairs], pa.string()), pa.array([t for _, t in pairs], pa.string())]
            else:
                for token, n in tokens.items():
                    for term in _TERM.findall(token):
                        counted[None, fold(term)] += n
                columns = [pa.array([e for e, _ in counted], pa.string()), pa.array([t for _, t in counted], pa.string()), pa.array(list(counted.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return rows.mapInArrow(run, out)


def sanitised(documents: DataFrame, model: DataFrame, key: str, text: str = "text", clean: str = "sanitised") -> DataFrame:
    """Every text with placeholders for personal information and for the terms that disclose one of its persons: ``key, clean``.

    ``key`` must be unique. A document meets only the disclosing terms of its own persons that stand in their sentences, so what it is joined with is bounded by its length.
    Null texts stay null.
    """
    telling = disclosing_terms(documents, model, text).select("entity", "term")
    own = skew_join(_met(documents, model, text, key), telling, ["entity", "term"], "left_semi").groupBy(F.col(key).alias("_key")).agg(F.collect_set("term").alias("_told"))
    joined = documents.select(key, F.col(text).alias("_whole")).join(own, F.col(key) == F.col("_key"), "left").drop("_key")
    rows = with_spans(joined.withColumn("_again", F.col("_whole")), model, [key, "_whole", "_told"], "_again")
    schema = T.StructType([documents.schema[key], T.StructField(clean, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, terms, spans in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if value is None:
                    out.append(None)
                    continue
                taken = [(s["kind"], s["char_start"], s["char_end"]) for s in spans]
                told = set(terms or ())
                more = [("term", m.start(), m.end()) for m in _WORD.finditer(value) if fold(m.group()) in told] if told else []
                free = [w for w in more if not any(s < w[2] and w[1] < e for _, s, e in taken)]
                out.append(redact(value, sorted(taken + free, key=lambda x: x[1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
