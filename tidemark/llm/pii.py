"""Operator 8: personal data as format-preserving pseudonyms.

Numbers that pass their check (card and IBAN check digits, octets, calendar dates, social
security ranges, digits of a telephone number) and mail addresses are replaced by values of the
same format: a keyed Feistel network permutes the values of each format, so equal values
stay equal, different ones stay different, and check digits stay right. Values that fail
their check are left alone. Cards and IBANs are also looked for inside longer runs of groups,
where other numbers or words stand beside them. One pass in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import itertools
import logging
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import carried, restored, widened
from .textops import pieces_of

#: Where a session names its key. Whoever must not undo the pseudonyms must not know it: give your own.
KEY_SETTING = "spark.tidemark.pii.key"
#: The key where none is named, as in the registered query: an example.
QUERY_KEY = b"tidemark example key"
ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

#: The country calling codes of two digits. Those that begin with 1 or 7 have one digit, all others three.
TWO_DIGIT_CODES = (20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58, 60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98)

#: Formats, in order of precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{4})(?![0-9A-Za-z/-]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])(?<![0-9][.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])",
}
_COMPILED = {k: re.compile(v) for k, v in PATTERNS.items()}
_HAS_DIGIT = re.compile("[0-9]")
#: Groups of digits, one after another, that may hold a card and more.
_CARD_RUN, _GROUP = re.compile(r"[0-9](?:[ -]?[0-9]){12,}"), re.compile("[0-9]+")
_CARD_DIGITS, _FEW = (13, 19), 6
#: The first digits of the card networks, and how groups are commonly written.
_ISSUER = re.compile(r"4|5[0-9]|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)|3[4-9]|30[0-59]|6[0-9]|1800|2131")
_USUAL = re.compile(r"1[3-9]|4 4 4 [1-4]|4 4 4 4 [1-3]|4 6 [45]")
_IBAN_HEAD, _IBAN_WORD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}"), re.compile(r" ?[A-Z0-9]+")
_IBAN_BODY, _IBAN_SPAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"), 43


class Permutation:
    """Keyed permutations of the integers below any bound: Feistel rounds, walked along their cycle into the bound."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def __call__(self, x: int, bound: int, format: str, allowed=None) -> int:
        """The image of x; values that are not `allowed` are walked over, so allowed ones map to allowed ones."""
        if bound < 2:
            return x
        half = max(1, ((bound - 1).bit_length() + 1) // 2)
        mask, size = (1 << half) - 1, (half + 7) // 8
        name = format.encode()[:16]
        while True:
            left, right = x >> half, x & mask
            for i in range(ROUNDS):
                f = hashlib.blake2b(bytes([i]) + right.to_bytes(size, "big"), digest_size=8 + size, key=self.key, person=name).digest()
                left, right = right, left ^ (int.from_bytes(f, "big") & mask)
            x = (left << half) | right
            if x < bound and (allowed is None or allowed(x)):
                return x


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def fill(shape: str, digits: str) -> str:
    """shape with its digits replaced, in order."""
    new = iter(digits)
    return "".join(next(new) if c in "0123456789" else c for c in shape)


def _digits(p: Permutation, shape: str, format: str, kept: int = 0, allowed=None) -> str:
    d = re.sub("[^0-9]", "", shape)
    body = d[kept:]
    image = p(int(body), 10 ** len(body), f"{format}{len(body)}", allowed)
    return fill(shape, d[:kept] + str(image).zfill(len(body)))


def _alphanumeric(p: Permutation, text: str, format: str) -> str:
    """Letters to letters of their case, digits to digits, as one mixed-radix number."""
    radix = [10 if c in "0123456789" else 26 if c.isascii() and c.isalpha() else 1 for c in text]
    value, bound = 0, 1
    for c, r in zip(text, radix, strict=True):
        at = int(c) if r == 10 else ord(c.lower()) - 97 if r == 26 else 0
        value, bound = value * r + at, bound * r
    value = p(value, bound, f"{format}{len(text)}")
    out = []
    for c, r in zip(reversed(text), reversed(radix), strict=True):
        value, at = divmod(value, r)
        new = str(at) if r == 10 else chr(97 + at) if r == 26 else c
        out.append(new.upper() if r == 26 and c.isupper() else new)
    return "".join(reversed(out))


def _card(p, s):
    d = re.sub("[^0-9]", "", s)
    if not luhn(d) or len(set(d)) == 1:
        return None
    body = str(p(int(d[:-1]), 10 ** (len(d) - 1), f"card{len(d)}", lambda x: x % (10 ** (len(d) - 1) // 9) != 0)).zfill(len(d) - 1)
    return fill(s, body + next(c for c in "0123456789" if luhn(body + c)))


def _iban_rest(country: str, body: str, check: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


def _iban(p, s):
    d = s.replace(" ", "")
    if not 15 <= len(d) <= 34 or _iban_rest(d[:2], d[4:], d[2:4]) != 1:
        return None
    body = _alphanumeric(p, d[4:], "iban" + d[:2])
    new = iter(d[:2] + f"{98 - _iban_rest(d[:2], body, '00'):02d}" + body)
    return "".join(c if c == " " else next(new) for c in s)


def _ipv4(p, s):
    octets = [int(x) for x in s.split(".")]
    if max(octets) > 255:
        return None
    x = p(int.from_bytes(bytes(octets), "big"), 2**32, "ipv4")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(p, s):
    parts = [int(x) for x in re.split(r"[./-]", s)]
    year_first = len(re.split(r"[./-]", s)[0]) == 4
    orders = [(0, 1, 2)] if year_first else [(2, 1, 0), (2, 0, 1)]
    for order in orders:
        try:
            day = datetime.date(*(parts[i] for i in order)).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            continue
        # Month first is only read where day first makes no date; the image must be such a date too, so no two dates share one.
        month_first = order == (2, 0, 1)
        late = (lambda x: datetime.date.fromordinal(FIRST_DAY + x).day > 12) if month_first else None
        new = datetime.date.fromordinal(FIRST_DAY + p(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date-m" if month_first else "date", late))
        values = dict(zip(order, (new.year, new.month, new.day), strict=True))
        widths = [len(x) for x in re.split(r"[./-]", s)]
        marks = re.findall(r"[./-]", s)
        texts = [str(values[i]).zfill(4 if values[i] == new.year and order[0] == i else max(2, widths[i]) if widths[i] == 2 else 1) for i in range(3)]
        return texts[0] + marks[0] + texts[1] + marks[1] + texts[2]
    return None


def _ssn(p, s):
    def real(x):
        area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
        return area not in (0, 666) and area < 900 and group > 0 and serial > 0

    return _digits(p, s, "ssn", allowed=real) if real(int(s.replace("-", ""))) else None


def _phone(p, s):
    d = re.sub("[^0-9]", "", s)
    if not 8 <= len(d) <= 15:
        return None
    return _digits(p, s, "phone", kept=calling_code(d) if s.startswith("+") else 0)


def calling_code(digits: str) -> int:
    """How many digits of an international number are its country's code; how the number is grouped doesn't matter."""
    return 1 if digits[0] in "17" else 2 if int(digits[:2]) in TWO_DIGIT_CODES else 3


def _email(p, s):
    local, _, domain = s.rpartition("@")
    return f"{_alphanumeric(p, local, 'mail')}@{domain}"


def _cards(text: str):
    """Spans that may be a card, likely ones first: as networks write them, the longest matches, then other groups of a longer run.

    A part of a run counts if it is grouped as cards usually are, or starts as a network's cards and is in few or in
    equal groups: any tenth part of a table or list of numbers passes the check digit.
    """
    likely, usual_only, issued_only = [], [], []
    for run in _CARD_RUN.finditer(text):
        groups = [m.span() for m in _GROUP.finditer(text, *run.span())]
        if len(groups) < 2:
            continue
        digits = re.sub("[ -]", "", run[0])
        ends, sums = list(itertools.accumulate((b - a for a, b in groups), initial=0)), []
        for odd in (0, 1):  # check sums when digits at even, or odd, places are doubled
            sums.append(list(itertools.accumulate((2 * x - 9 * (x > 4) if i % 2 == odd else x for i, x in enumerate(map(int, digits))), initial=0)))
        first = 1 if re.search("[A-Za-z]$|[0-9][.-]$", text[max(0, run.start() - 2) : run.start()]) else 0
        last = len(groups) - 1 if re.match("[A-Za-z]|[.-][0-9]", text[run.end() : run.end() + 2]) else len(groups)
        for i in range(first, last):
            low, high = bisect.bisect_left(ends, ends[i] + _CARD_DIGITS[0]), bisect.bisect_right(ends, ends[i] + _CARD_DIGITS[1])
            for j in range(min(high - 1, last), low - 1, -1):
                of = sums[ends[j] % 2]
                if (of[ends[j]] - of[ends[i]]) % 10:
                    continue
                sizes = [y - x for x, y in groups[i:j]]
                usual = _USUAL.fullmatch(" ".join(map(str, sizes))) is not None
                issued = _ISSUER.match(digits, ends[i]) is not None and (len(sizes) <= _FEW or len(set(sizes[:-1])) == 1 >= sizes[-1] / sizes[0])
                if usual or issued:
                    (likely if usual and issued else usual_only if usual else issued_only).append((groups[i][0], groups[j - 1][1]))
    yield from likely
    yield from (m.span() for m in _COMPILED["card"].finditer(text))
    yield from usual_only
    yield from issued_only


def _ibans(text: str):
    """Spans that may be an IBAN: from each head the longest first, then shorter ends between words."""
    for head in _IBAN_HEAD.finditer(text):
        ends, at = [], head.end()
        while at - head.start() <= _IBAN_SPAN and (word := _IBAN_WORD.match(text, at)):
            at = word.end()
            ends.append(at)
        for end in reversed(ends):
            if not re.match("[A-Za-z0-9]", text[end : end + 1]) and _IBAN_BODY.fullmatch(text, head.start(), end):
                yield head.start(), end


#: Formats whose values may stand among more of the same characters; of others each match is one span.
SPANS_OF = {"card": _cards, "iban": _ibans}
REPLACE = {"email": _email, "iban": _iban, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonyms(text: str, permutation: Permutation, kinds=tuple(PATTERNS)) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of what was replaced in it, in order."""
    found: list[tuple[int, int, str, str]] = []
    if _HAS_DIGIT.search(text) or "@" in text:
        taken = bytearray(0)
        for kind in kinds:
            if kind == "email" and "@" not in text:
                continue
            for start, end in SPANS_OF[kind](text) if kind in SPANS_OF else (m.span() for m in _COMPILED[kind].finditer(text)):
                if taken and any(taken[start:end]):
                    continue
                new = REPLACE[kind](permutation, text[start:end])
                if new is not None:
                    taken = taken or bytearray(len(text))
                    taken[start:end] = b"\1" * (end - start)
                    found.append((start, end, kind, new))
    if not found:
        return text, []
    out, at = [], 0
    for start, end, _, new in sorted(found):
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), [(kind, start, end - start) for start, end, kind, _ in sorted(found)]


SPANS = "array<struct<kind:string,start:int,length:int>>"


def _replaced(docs: DataFrame, key: bytes, kinds) -> DataFrame:
    """The text with pseudonyms, the other columns of docs in `_own`, n_pii and spans."""
    rows = docs.select(*carried(docs, "text"))

    def run(batches):
        p = Permutation(key)
        for batch in (rows for whole in batches for rows in pieces_of(whole)):
            done = [(None, []) if t is None else pseudonyms(t, p, kinds) for t in batch.column("text").to_pylist()]
            spans = [[{"kind": k, "start": s, "length": n} for k, s, n in x] for _, x in done]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("_own"), pa.array([t for t, _ in done], pa.string()), pa.array([len(x) for _, x in done], pa.int64()), pa.array(spans, kind)], ["_own", "text", "n_pii", "spans"])

    return rows.mapInArrow(run, widened(StructType([rows.schema["_own"]]), f"text string, n_pii long, spans {SPANS}"))


def pseudonymise(docs: DataFrame, key: bytes, kinds=tuple(PATTERNS)) -> DataFrame:
    """docs with pseudonyms in text, n_pii (values replaced) and spans (where, in characters of the old text).

    A null text stays null with no spans, an empty one empty; whole texts of any length are
    looked through. Columns named n_pii or spans, in any case of letters, are replaced.
    Repeated rows are treated one by one and alike. Of values that overlap, that of the
    format named first in PATTERNS is replaced.
    """
    docs = docs.drop("n_pii", "spans")
    return _replaced(docs, key, kinds).select(*restored(docs, text=F.col("text")), "n_pii", "spans")


def key_of(spark) -> bytes:
    """The key in the session's setting `spark.tidemark.pii.key`; unset, the example key, which hides nothing from readers of this file."""
    given = spark.conf.get(KEY_SETTING, None)
    if not given:
        logging.getLogger("tidemark").warning("%s is unset: pseudonyms are made with the example key", KEY_SETTING)
    return given.encode() if given else QUERY_KEY


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, key_of(spark)).select("doc_id", "n_pii", "spans", "text")


def pseudonymise_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents with pseudonyms; n_chars follows the text. All other columns stay as they are."""
    rows = _replaced(docs, key_of(spark), tuple(PATTERNS))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kept = F.col("_own").getField("n_chars")
        new["n_chars"] = F.when(F.col("n_pii") > 0, F.length("text")).otherwise(kept).cast(docs.schema["n_chars"].dataType)
    return rows.select(*restored(docs, **new))
