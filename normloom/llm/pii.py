"""Personal information inside free text.

Finds e-mail addresses, telephone numbers, identity numbers, postal addresses and names of persons in Vietnamese, English
and Malay text and replaces them with typed placeholders.

Method: format-preserving Feistel pseudonyms. A validated number, or the date inside one, is permuted by a keyed Feistel
network over the strings of its own length, so that the same value has the same pseudonym in every document, different
values have different ones, and the written shape (prefix, grouping, separators) stays. Values without a number format get a keyed code.
"""

from __future__ import annotations

import datetime
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normloom.plans.session import spread

TYPES = ("email", "phone", "id_number", "address", "person")

# --- fixed values: words of the three languages -------------------------------------------------------------------------
#: Vietnamese family names, without accents.
FAMILY = (
    "nguyen tran le pham hoang huynh phan vu vo dang bui do ho ngo duong ly dinh trinh mai dao doan lam luong truong cao ta ha chu thai to "
    "mac kieu quach la luu vuong tang au lai ninh nghiem diep kim thach tong vi ung tieu son phung khuat giap ngac hua la khong dam ton bach chau lac thieu trieu nong lo luc phi quang ma sam tham"
).split()
#: Common English and Malay given names: a capitalised name that follows makes a person, without any other context.
GIVEN = frozenset(
    "James Robert John Michael David William Richard Joseph Thomas Christopher Charles Daniel Matthew Anthony Mark Steven Andrew Paul Joshua Kenneth Kevin Brian Timothy Ronald George Edward Jason Jeffrey Ryan Jacob "
    "Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Benjamin Samuel Gregory Patrick Peter Henry Douglas Simon Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Sandra Ashley Emily "
    "Kimberly Margaret Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Sharon Cynthia Amy Kathleen Angela Helen Anna Emma Nicole Samantha Catherine Christine Rachel Maria Alice Julia Jane Diana Hannah "
    "Siti Nur Nurul Noor Mohd Mohamad Mohammad Muhammad Ahmad Abdul Ismail Ibrahim Hassan Azman Azlan Faizal Hafiz Zulkifli Rosli Razak Rahman Aminah Fatimah Aishah Khadijah Zainab Norhayati Farah".split()
)
#: Words between a Malay given name and the father's name.
PATRONYM = r"(?i:binti|bin|bte?\.?|b\.|a/[lp]|anak)"
TITLES = "Encik En. Puan Pn. Cik Tuan Dato' Datuk Datin Mr Mr. Mrs Mrs. Ms Ms. Miss Dr Dr. Prof Prof. Ông Bà Anh Chị Cô ông bà anh chị cô".split()
#: Words before an identity number.
ID_LABEL = r"(?i)(?:CCCD|CMND|căn cước(?: công dân)?|chứng minh(?: nhân dân)?|tùy thân|định danh|K/?P|kad pengenalan|MyKad|passport|pasport|hộ chiếu|identity|card|\bID)\b[^\d\n]{0,24}$"
#: Words before numbers that are none: documents, cases, batches, transactions, forms.
OTHER_LABEL = r"(?i)(?:giao dịch|hồ sơ|batch|reference|ref\.?|rujukan|kelompok|transaction|transaksi|case|kes|mã|lô|invoice|hóa đơn|văn bản|circular|pekeliling)\b[^\d\n.;!?]{0,16}$"
#: Words that can only stand before a telephone number, whatever stands further left.
CALL_LABEL = r"(?i)(?:điện thoại|số máy|gọi số|di động|telefon|telephone|phone|mobile|hotline)\b[^\d\n]{0,3}$"
PHONE_LABEL = r"(?i)(?:điện thoại|số máy|gọi số|di động|tel|telefon|phone|call|mobile|hubungi|nombor|number|hotline|fax)\b[^\d\n]{0,16}$"

# --- shapes -----------------------------------------------------------------------------------------------------------
EMAIL = regex.compile(
    r"(?<![\w.+\-@])[A-Za-z0-9][A-Za-z0-9._%+\-]*(?:@| @ |\s?[\[({]\s?(?:at|AT)\s?[\])}]\s?)[A-Za-z0-9\-]+(?:(?:\.|\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?)[A-Za-z0-9\-]+)+"
)
DIGITS = regex.compile(r"(?<![\w/@.,+\-])(?:\+\s?)?\(?\d(?:[ .\-]?[()]?[ .\-]?\d){6,17}(?![\w/@]|[.,\-]\d)")
PASSPORT = regex.compile(r"(?<![\w\-/])[A-Z]{1,2}\d{6,8}(?![\w\-/])")
WORD = r"\p{Lu}[\p{L}\p{M}'’]*"
PLACE = rf"{WORD}(?:[ \-]{WORD})*"
ROAD_MS = r"(?:Jalan|Jln\.?|Lorong|Lrg\.?|Persiaran|Lebuhraya|Lebuh|Taman|Kampung|Kg\.?)"
ROAD_EN = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Close|Court|Crescent|Way|Place|Square|Boulevard|Blvd\.?|Terrace|Hill|Row)"
#: The first letter of a Vietnamese part may be written large or small; a town or ward is a name or a number.
_VI_ROAD = r"(?:[đĐ]ường|[pP]hố|[đĐ]ại lộ)"
_VI_PART = r"(?:[nN]gõ|[nN]gách|[hH]ẻm|[kK]iệt|[tT]ổ|[kK]hu phố|[xX]ã|[pP]hường|[tT]hị trấn|[tT]hị xã|[hH]uyện|[qQ]uận|[tT]hành phố|[tT]ỉnh|TP\.?|Q\.|P\.)"
ADDRESS = [
    regex.compile(
        rf"(?<![\w/])(?:(?:[sS]ố(?: nhà)? )?\d+[A-Za-z]?(?:/\d+[A-Za-z]?)*,? (?:(?:[nN]gõ|[nN]gách|[hH]ẻm|[kK]iệt) \d+[\d/]*,? )*{_VI_ROAD} (?:{PLACE}|\d+)"
        rf"|(?:[tT]hôn|[ấẤ]p|[bB]ản|[lL]àng|[xX]óm|[tT]ổ) (?:\d+|{PLACE})(?=, ))(?:, (?:{_VI_PART} (?:{PLACE}|\d+)|{PLACE}))+"
    ),
    regex.compile(rf"(?<![\w/])(?:(?:No\.?|Lot|Unit|Blok|Block) ?)?\d+[A-Z]?(?:[\-/]\d+)*,? {ROAD_MS} {PLACE}(?: \d+(?:/\d+[A-Z]?)*)?(?:, (?:\d{{5}} )?{PLACE})+(?: \d{{5}})?"),
    regex.compile(rf"(?<![\w/])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite) \d+[A-Z]?, )?\d+[A-Z]? (?:{WORD} ){{1,3}}{ROAD_EN}(?:, {PLACE})+(?: \d{{5}}(?:-\d{{4}})?)?"),
]
_NAME = r"(?:\p{Lu}\. ?|\p{Lu}[\p{L}\p{M}'’\-]+ ){0,3}\p{Lu}[\p{L}\p{M}'’\-]+"
VIETNAMESE = regex.compile(rf"(?<![\p{{L}}\p{{M}}\d'’\-@._]|\p{{Lu}}\p{{L}}* )(\p{{Lu}}[\p{{L}}\p{{M}}]*)(?: \p{{Lu}}[\p{{L}}\p{{M}}]+){{1,4}}(?![\p{{L}}\p{{M}}\d@_])")
MALAY = regex.compile(rf"(?<![\p{{L}}\p{{M}}\d'’\-@._])(?:{WORD} ){{1,3}}{PATRONYM} {WORD}(?: {WORD})?(?![\p{{L}}\p{{M}}@_])")
TITLED = regex.compile(rf"(?<![\p{{L}}\p{{M}}\d])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Encik|En|Puan|Pn|Cik|Tuan|Dato'|Datuk|Datin|[ôÔ]ng|[bB]à)\.? ({_NAME})(?![\p{{L}}\p{{M}}@_])")
LABELLED = regex.compile(rf"(?:(?<![\p{{L}}])(?:Full name|Name|Nama(?: penuh)?|Họ(?: và)? tên|Tên)\s?:\s?|(?:prepared|signed|drafted|filed|witnessed|submitted) by |(?:disediakan|ditandatangani|disaksikan|dikemukakan) oleh |(?:trình bày|đơn|ý kiến) của |[bB]iên bản do )({_NAME})(?![\p{{L}}\p{{M}}@_])")
#: Words for what persons do, right behind a name: the context that makes two capitalised words a person.
ACTS = "|".join((
    *"asked requested applied appealed objected met attended signed wrote called said stated confirmed complained reported visited emailed phoned replied paid bought sold lives works joined resigned".split(),
    *"memohon meminta merayu hadir menandatangani menulis menelefon berkata menyatakan mengesahkan melaporkan membayar tinggal bekerja".split(),
    "đề nghị", "yêu cầu", "kiến nghị", "khiếu nại", "trình bày", "gửi đơn", "ký tên", "xác nhận", "cho biết", "tham dự", "phản ánh",
))
ACTING = regex.compile(rf"(?<![\p{{L}}\p{{M}}\d'’\-@._])((?:\p{{Lu}}\. ?|\p{{Lu}}[\p{{L}}\p{{M}}'’\-]+ )(?:\p{{Lu}}\. ?)?\p{{Lu}}[\p{{L}}\p{{M}}'’\-]+) (?:{ACTS})(?![\p{{L}}])")
#: A common given name and one or two capitalised names behind it.
NAMED = regex.compile(rf"(?<![\p{{L}}\p{{M}}\d'’\-@._])(\p{{Lu}}\p{{Ll}}+)((?: \p{{Lu}}\.)?(?: \p{{Lu}}[\p{{L}}\p{{M}}'’\-]+){{1,2}})(?![\p{{L}}\p{{M}}\d@_])")
#: Capitalised words that begin sentences or headings and are no names.
NO_NAME = frozenset("the each an in where for subject section seksyen form borang release keluaran case kes batch điều mục theo trong ngoài trước khi đối bên cơ người tổ ban bộ nhóm hội đơn đại chi căn mã thẻ phiên mức gửi biên giấy".split())
#: Words of offices and bodies, which act like persons.
NO_NAME |= frozenset("committee office function board department bank team unit council authority ministry company group panel branch agency commission institution member regulator division section jawatankuasa jabatan lembaga bahagian kementerian syarikat".split())
_FOLD = str.maketrans("đĐ", "dD")


def fold(text: str) -> str:
    """Lower case without accents."""
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text.translate(_FOLD)) if not unicodedata.combining(c)).lower()


_FAMILY = frozenset(FAMILY)
_ID, _OTHER, _PHONE, _CALL = (regex.compile(p) for p in (ID_LABEL, OTHER_LABEL, PHONE_LABEL, CALL_LABEL))


#: No label is longer than this with all that may stand between it and its number.
LOOK_BACK = 48
#: Place codes that no identity card of Malaysia has (the first is used for invented ones).
NO_PLACE = ("00", "17", "18", "19", "20", "69", "70", "73", "80", "81", "94", "95", "96", "97")
FAKE_PLACE = "00"


def _born(six: str) -> datetime.date | None:
    """The date that YYMMDD states; the century doesn't matter for its validity but for 29 February."""
    for century in (1900, 2000):
        try:
            return datetime.date(century + int(six[:2]), int(six[2:4]), int(six[4:]))
        except ValueError:
            continue
    return None


def kind_of_number(surface: str, before: str) -> str | None:
    """'phone', 'id_number' or None for a run of digits and separators; before is the text to its left, which decides
    where the shape alone doesn't."""
    digits = "".join(c for c in surface if c.isdigit())
    shape = regex.sub(r"\d+", lambda m: str(len(m[0])) + " ", regex.sub(r"[^\d]+", "-", surface.strip("()+ "))).replace("-", "").split()
    plus, n = surface.lstrip("(").startswith("+"), len(digits)
    if plus:
        rest = digits.removeprefix("84") if digits.startswith("84") else digits.removeprefix("60") if digits.startswith("60") else digits[1:] if digits.startswith("1") else digits
        return "phone" if 7 <= len(rest) <= 11 else None
    if digits.startswith("0084") and 12 <= n <= 14 or digits.startswith("0060") and 12 <= n <= 14:
        return "phone"
    is_id, other = bool(_ID.search(before)), bool(_OTHER.search(before)) and not _CALL.search(before)
    if n == 12:
        if shape == ["6", "2", "4"] and _born(digits[:6]):
            return "id_number"
        if is_id:
            return "id_number"
        if other:
            return None
        place = digits[6:8]
        return "id_number" if digits[0] == "0" or _born(digits[:6]) and (place == FAKE_PLACE or place not in NO_PLACE) else None
    if n == 9 and (shape == ["3", "2", "4"] or is_id and len(shape) == 1):
        return "id_number"
    if other:
        return None
    if digits[0] == "0" and n in (9, 10, 11) and "," not in surface:
        return "phone"
    if n == 10 and shape in (["3", "3", "4"], ["10"] if _PHONE.search(before) else None):
        return "phone"
    return None


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of every stretch, in order, without overlaps. Labels, courtesy titles and closing punctuation
    are outside; null and empty texts have none."""
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))

    def take(start: int, end: int, kind: str) -> None:
        if not any(taken[start:end]):
            taken[start:end] = b"\x01" * (end - start)
            spans.append((start, end, kind))

    for m in EMAIL.finditer(text):
        take(m.start(), m.end(), "email")
    for pattern in ADDRESS:
        for m in pattern.finditer(text):
            take(m.start(), m.end(), "address")
    for m in DIGITS.finditer(text):
        kind = kind_of_number(m[0], text[max(0, m.start() - LOOK_BACK) : m.start()])
        if kind:
            take(m.start(), m.end(), kind)
    for m in PASSPORT.finditer(text):
        if _ID.search(text[max(0, m.start() - LOOK_BACK) : m.start()]) or regex.fullmatch(r"[A-Z]{2}\d{7}", m[0]):
            take(m.start(), m.end(), "id_number")
    for m in MALAY.finditer(text):
        words, start = m[0].split(" "), m.start()
        title = max((k for k, w in enumerate(words) if w in TITLES), default=-1)  # what stands before a title is no name
        for _ in range(title + 1):
            start += len(words.pop(0)) + 1
        while words and words[0].lower() in NO_NAME:
            start += len(words.pop(0)) + 1
        if len(words) > 2:
            take(start, m.end(), "person")
    for m in VIETNAMESE.finditer(text):
        first = fold(m[1])
        if first in _FAMILY and not (first in ("do", "to", "ha", "an") and m[0].count(" ") == 1 and m[1].isascii()):
            take(m.start(), m.end(), "person")
    for m in NAMED.finditer(text):
        if m[1] in GIVEN and not {w.lower() for w in m[0].split()} & NO_NAME:
            take(m.start(), m.end(), "person")
    for pattern in (TITLED, LABELLED, ACTING):
        for m in pattern.finditer(text):
            words, start = m[1].split(" "), m.start(1)
            while words and (words[0] in TITLES or words[0].rstrip(".") in TITLES):
                start += len(words.pop(0)) + 1
            if words and not {w.lower() for w in words} & NO_NAME:
                take(start, m.end(1), "person")
    return sorted(spans)


# --- pseudonyms ---------------------------------------------------------------------------------------------------------
ROUNDS = 10


def _mix(key: bytes, tweak: bytes, right: str, size: int) -> int:
    return int.from_bytes(hashlib.blake2s(tweak + right.encode(), key=key, digest_size=16).digest()) % 10**size


def permute_digits(digits: str, key: bytes, tweak: bytes = b"", back: bool = False) -> str:
    """A keyed permutation of the digit strings of one length (two digits or more), by an alternating Feistel network."""
    n = len(digits)
    if n < 2:
        return digits
    a, b = digits[: n // 2], digits[n // 2 :]
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        mark = tweak + bytes((r, n))
        if back:
            a, b = f"{(int(b) - _mix(key, mark, a, len(b))) % 10 ** len(b):0{len(b)}d}", a
        else:
            a, b = b, f"{(int(a) + _mix(key, mark, b, len(a))) % 10 ** len(a):0{len(a)}d}"
    return a + b


def permute_among(value: int, size: int, digits: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of 0 to size - 1, by walking the cycle of the permutation of all strings of that many digits."""
    while True:
        value = int(permute_digits(f"{value:0{digits}d}", key, tweak))
        if value < size:
            return value


def permute_date(six: str, key: bytes) -> str:
    """A keyed permutation of the dates YYMMDD that exist in this or the last century (those of 2000 to 2099)."""
    first, days = datetime.date(2000, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(2000, 1, 1)).days
    at = (datetime.date(2000 + int(six[:2]), int(six[2:4]), int(six[4:])) - first).days
    return (first + datetime.timedelta(days=permute_among(at, days, 5, key, b"date"))).strftime("%y%m%d")


def permute_place(place: str, key: bytes) -> str:
    """A keyed permutation of the place codes in use; a code that isn't stays among those."""
    codes = [f"{i:02}" for i in range(100) if (f"{i:02}" in NO_PLACE) == (place in NO_PLACE)]
    return codes[permute_among(codes.index(place), len(codes), 2, key, b"place" + bytes((len(codes),)))]


def _refill(surface: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in surface)


def _is_card(surface: str, digits: str) -> bool:
    """Whether 12 digits are a date, a place and a serial number: grouped so, or not beginning like a number that starts with a province (0)."""
    groups = [len(g) for g in regex.findall(r"\d+", surface)]
    return _born(digits[:6]) is not None and (groups == [6, 2, 4] or digits[0] != "0" and groups == [12])


@lru_cache(maxsize=100_000)
def placeholder(surface: str, kind: str, key: bytes) -> str:
    """'[TYPE:pseudonym]'. The same value, however it is grouped or capitalised, has the same pseudonym digits or code."""
    digits = "".join(c for c in surface if c.isdigit())
    if kind == "phone":
        national = digits
        for code in ("0084", "0060", "84", "60") if surface.lstrip("(").startswith(("+", "00")) else ("0",):
            if digits.startswith(code):
                national = digits[len(code) :]
                break
        return f"[PHONE:{_refill(surface, digits[: len(digits) - len(national)] + permute_digits(national, key, b'phone'))}]"
    if kind == "id_number" and len(digits) == 12 and _is_card(surface, digits):
        moved = permute_date(digits[:6], key) + permute_place(digits[6:8], key)
        return f"[ID_NUMBER:{_refill(surface, moved + permute_digits(digits[8:], key, b'serial' + digits[:8].encode()))}]"
    if kind == "id_number" and len(digits) >= 6:
        return f"[ID_NUMBER:{_refill(surface, digits[0] + permute_digits(digits[1:], key, b'id'))}]"
    plain = " ".join(unicodedata.normalize("NFC", surface).lower().replace("[at]", "@").replace("[dot]", ".").split())
    if kind == "email":
        plain = plain.replace(" ", "")
    return f"[{kind.upper()}:{hashlib.blake2s(plain.encode(), key=key, digest_size=16).hexdigest()}]"


def pseudonyms(text: str | None, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, type, placeholder) of every stretch of find()."""
    return [(a, b, kind, placeholder(text[a:b], kind, key)) for a, b, kind in find(text)] if text else []


def mask(text: str | None, key: bytes) -> str | None:
    """The text with placeholders; what is outside the stretches stays unchanged. Null stays null."""
    if not text:
        return text
    out, at = [], 0
    for start, end, _, instead in pseudonyms(text, key):
        out += [text[at:start], instead]
        at = end
    return "".join([*out, text[at:]])


SPANS = (("start", T.IntegerType()), ("pii_type", T.StringType()), ("surface", T.StringType()), ("placeholder", T.StringType()))


def spans(docs: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text", once: bool = False) -> DataFrame:
    """(key, start, pii_type, surface, placeholder): one row per stretch (start in code points), with what masked() puts in its place; once: one per distinct
    stretch and type of a document, the first."""
    schema = T.StructType([docs.schema[key], *[T.StructField(n, t) for n, t in SPANS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, columns = [], ([], [], [], [])
            for row, t in enumerate(batch.column(1).to_pylist()):
                rows = [(a, kind, t[a:b], instead) for a, b, kind, instead in pseudonyms(t, secret)]
                for values in {r[1:3]: r for r in reversed(rows)}.values() if once else rows:
                    at.append(row)
                    for c, v in zip(columns, values, strict=True):
                        c.append(v)
            made = [pa.array(c, pa.int32() if i == 0 else pa.string()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *made], schema.names)

    return spread(docs.select(key, text)).mapInArrow(run, schema)


def found(docs: DataFrame, secret: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pii_type, surface): one row per distinct stretch and type of a document, of the stretches that masked() replaces."""
    return spans(docs, secret, key, text, once=True).select(key, "pii_type", "surface")


def masked(docs: DataFrame, secret: bytes, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and the text with placeholders. secret keys the pseudonyms: with the same one they stay linked."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([mask(t, secret) for t in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], schema.names)

    return spread(docs.select(*keep, text)).mapInArrow(run, schema)


def restored(masked_docs: DataFrame, rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): the masked texts with the surfaces of spans() put back in their places, in built-in expressions."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "surface", "placeholder"))).alias("spans"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("shift"))

    def step(acc, x):
        here = x["start"] + acc["shift"]  # where the placeholder stands in the masked text
        return F.struct(
            F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, here - acc["at"]), x["surface"]).alias("out"), (here + F.length(x["placeholder"])).alias("at"),
            (acc["shift"] + F.length(x["placeholder"]) - F.length(x["surface"])).alias("shift"),
        )

    joined = masked_docs.select(key, text).join(listed, key, "left")
    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.lit(1 << 30))))
    return joined.select(key, F.when(F.col("spans").isNull(), F.col(text)).otherwise(done).alias(text))
