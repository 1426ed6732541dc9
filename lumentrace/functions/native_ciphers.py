"""Ciphers and encodings that Spark's own expressions can do; keys are plan-time literals.

CIP-01..07, CIP-10..12, CIP-16, CIP-17, CIP-34 and ENC-01, 02, 04..08.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import let

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The order of keys on each layout.
KEYBOARDS = {
    "QWERTY": "1234567890qwertyuiopasdfghjklzxcvbnm",
    "AZERTY": "1234567890azertyuiopqsdfghjklmwxcvbn",
    "DVORAK": "1234567890pyfgcrlaoeuidhtns-;qjkxbmwvz",
    "QWERTY_FULL": "1234567890-=qwertyuiop[]\\asdfghjkl;'zxcvbnm,./",
}
#: Morse code of letters and digits.
MORSE = dict(
    zip(
        LOWER + "0123456789",
        (".- -... -.-. -.. . ..-. --. .... .. .--- -.- .-.. -- -. --- .--. --.- .-. ... - ..- ...- .-- -..- -.-- --.. "
         "----- .---- ..--- ...-- ....- ..... -.... --... ---.. ----.").split(),
    )
)
#: Look-alike digits and the letters they stand for.
LEET_FROM, LEET_TO = "0134578@$", "oieastbas"


def rotate(alphabet: str, by: int) -> str:
    by %= len(alphabet)
    return alphabet[by:] + alphabet[:by]


def caesar(text: Column, shift: int) -> Column:
    """Letters moved by ``shift`` (negative decodes), case kept (CIP-01)."""
    return F.translate(text, UPPER + LOWER, rotate(UPPER, shift) + rotate(LOWER, shift))


def rot13(text: Column) -> Column:
    """Its own inverse (CIP-02)."""
    return caesar(text, 13)


def atbash(text: Column) -> Column:
    """Letters mirrored, its own inverse (CIP-03)."""
    return F.translate(text, UPPER + LOWER, UPPER[::-1] + LOWER[::-1])


def rot47(text: Column) -> Column:
    """The 94 printable ASCII characters moved by 47, its own inverse (CIP-04)."""
    printable = "".join(map(chr, range(33, 127)))
    return F.translate(text, printable, rotate(printable, 47))


def through_order(text: Column, order: str, shift: int) -> Column:
    """Characters of ``order`` slid along it; the result has the order's case (CIP-34)."""
    moved = dict(zip(order, rotate(order, shift)))
    table = dict(moved)
    for c, to in moved.items():
        for other in (c.lower(), c.upper()):
            if len(other) == 1:
                table.setdefault(other, to)
    return F.translate(text, "".join(table), "".join(table.values()))


def keyboard(text: Column, shift: int, layout: str = "QWERTY") -> Column:
    """Slides along a keyboard's rows; an unknown layout is QWERTY (CIP-05)."""
    return through_order(text, KEYBOARDS.get(layout, KEYBOARDS["QWERTY"]), shift)


def _shifts(key: str) -> list[int]:
    return [(ord(c) - 65) % 26 for c in key.strip().upper()]


def _by_key(text: Column, key: str, letter) -> Column:
    """Each letter by ``letter(value, key value)``; only letters move the key on (CIP-06, CIP-07).

    Letters are numbered by a running count held in one pass over the characters.
    """
    if not key.strip():
        return text
    shifts = F.array(*[F.lit(s) for s in _shifts(key)])
    chars = F.split(text, "")
    n = len(_shifts(key))

    def add(state: Column, c: Column) -> Column:
        code = F.ascii(c)
        upper, lower = (code >= 65) & (code <= 90) & (F.octet_length(c) == 1), (code >= 97) & (code <= 122) & (F.octet_length(c) == 1)
        base = F.when(upper, 65).otherwise(97)
        moved = F.char(F.pmod(letter(code - base, F.get(shifts, state["k"] % n)), F.lit(26)) + base)
        is_letter = upper | lower
        return F.struct(F.array_append(state["out"], F.when(is_letter, moved).otherwise(c)).alias("out"), (state["k"] + is_letter.cast("int")).alias("k"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("k"))
    return F.aggregate(chars, start, add, lambda s: F.array_join(s["out"], ""))


def vigenere(text: Column, key: str, decode: bool = False) -> Column:
    return _by_key(text, key, (lambda c, k: c - k) if decode else (lambda c, k: c + k))


def beaufort(text: Column, key: str) -> Column:
    return _by_key(text, key, lambda c, k: k - c)


def cleaned(text: Column) -> Column:
    """ASCII letters and digits, upper-cased: what transpositions work on."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def _picked(text: Column, order: Column) -> Column:
    """Characters of ``text`` at the places (from 0) of ``order``."""
    return let(F.split(text, ""), lambda chars: F.array_join(F.transform(order, lambda i: F.get(chars, i.cast("int"))), ""))


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def railfence(text: Column, rails: int) -> Column:
    """Read off rail by rail from a zigzag (CIP-10)."""
    if rails < 2:
        return text
    t, period = cleaned(text), 2 * rails - 2
    rail = lambda i: F.least(i % period, period - i % period)
    order = F.transform(F.array_sort(F.transform(_upto(F.length(t)), lambda i: F.struct(rail(i).alias("r"), i.alias("i")))), lambda s: s["i"])
    return F.when(F.length(t) > 0, _picked(t, order)).otherwise(t)


def _grid(text: Column, columns: list[int], width: int) -> Column:
    """Written in rows of ``width``, padded with X, read by the given columns."""
    t = cleaned(text)
    rows = F.ceil(F.length(t) / width).cast("int")
    padded = F.rpad(t, rows * width, "X")
    cells = lambda c: F.transform(_upto(rows), lambda r: r * width + c)
    each = [cells(c) for c in columns]
    return F.when(F.length(t) > 0, _picked(padded, F.concat(*each))).otherwise(t)


def scytale(text: Column, diameter: int) -> Column:
    """Written round a rod (CIP-11)."""
    return text if diameter < 1 else _grid(text, list(range(diameter)), diameter)


def columnar_order(key: str) -> list[int]:
    letters = list(dict.fromkeys(c for c in key.strip().upper() if ord(c) < 128))
    return sorted(range(len(letters)), key=lambda i: letters[i])


def columnar(text: Column, key: str) -> Column:
    """Columns read in the order of the key's characters, repeats dropped (CIP-12)."""
    order = columnar_order(key)
    return _grid(text, order, len(order)) if order else text


def polybius_square(key: str = "") -> str:
    return "".join(dict.fromkeys(c for c in key + UPPER if c in UPPER and c != "J"))


def polybius(text: Column, key: str = "") -> Column:
    """Row and column digits of each letter, J as I, parted by blanks (CIP-16)."""
    square = polybius_square(key)
    letters = F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), "J", "I")
    table = F.create_map(*[F.lit(x) for i, c in enumerate(square) for x in (c, f"{i // 5 + 1}{i % 5 + 1}")])
    return F.when(letters != "", F.array_join(F.transform(F.split(letters, ""), lambda c: F.element_at(table, c)), " ")).otherwise(letters)


def route_key(key: str) -> tuple[int, int, str, str]:
    """Rows, columns, direction and corner of ``RxC_direction_corner``; 4x4 clockwise top-left where it says nothing."""
    size, _, rest = key.strip().partition("_")
    direction, _, corner = rest.partition("_")
    rows, _, cols = size.partition("x")
    number = lambda s: int(s) if re.fullmatch(r"\+?\d+", s) and int(s) >= 1 else 4
    return (
        number(rows) if cols else 4, number(cols) if cols else 4,
        "counter-clockwise" if direction in ("counter-clockwise", "counterclockwise") else "clockwise",
        corner if corner in ("top-right", "bottom-left", "bottom-right") else "top-left",
    )


def route_order(key: str) -> list[int]:
    """Cells (row by row, from 0) in the order the spiral visits them.

    The heading turns only at a wall or a visited cell. From the bottom-left clockwise and
    the top-right corners the turns lead out of the grid, and the walk ends there, as it must for equal results.
    """
    rows, cols, direction, corner = route_key(key)
    right, down, left, up = (0, 1), (1, 0), (0, -1), (-1, 0)
    #: The headings in turn.
    headings = {
        ("clockwise", "top-left"): (right, down, left, up), ("clockwise", "top-right"): (left, down, right, up),
        ("clockwise", "bottom-left"): (right, up, left, down), ("clockwise", "bottom-right"): (left, up, right, down),
        ("counter-clockwise", "top-left"): (down, right, up, left), ("counter-clockwise", "top-right"): (down, left, up, right),
        ("counter-clockwise", "bottom-left"): (up, right, down, left), ("counter-clockwise", "bottom-right"): (up, left, down, right),
    }[direction, corner]
    at = (rows - 1 if corner.startswith("bottom") else 0, cols - 1 if corner.endswith("right") else 0)
    seen: dict[tuple[int, int], None] = {}
    turn = 0
    free = lambda p: 0 <= p[0] < rows and 0 <= p[1] < cols and p not in seen
    while len(seen) < rows * cols and 0 <= at[0] < rows and 0 <= at[1] < cols:
        seen[at] = None
        ahead = (at[0] + headings[turn][0], at[1] + headings[turn][1])
        if not free(ahead):
            turn = (turn + 1) % 4
            ahead = (at[0] + headings[turn][0], at[1] + headings[turn][1])
        at = ahead
    return [r * cols + c for r, c in seen]


def route(text: Column, key: str = "") -> Column:
    """Spiral route over one grid; text beyond it is cut, as it is by definition of the method (CIP-17)."""
    rows, cols, *_ = route_key(key)
    bare = F.replace(F.regexp_replace(text, "[ \\t\\n\\r]", ""), F.lit("ß"), F.lit("\ue000"))
    t = F.replace(F.upper(bare), F.lit("\ue000"), F.lit("ß"))  # one character stays one
    grid = F.rpad(t, rows * cols, "X")
    return F.when(t != "", _picked(grid, F.array(*[F.lit(i) for i in route_order(key)]))).otherwise(t)


def base64_encode(text: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "\\s", "")


def base64_decode(text: Column) -> Column:
    """Bytes of standard or URL-safe base64, padded or not; null where none of the four forms fits (ENC-01)."""
    body = F.regexp_replace(text, "=+$", "")
    pads = F.length(text) - F.length(body)
    mixed = body.rlike("[+/]") & body.rlike("[-_]")
    fits = ((pads == 0) & (F.length(body) % 4 != 1)) | ((pads > 0) & (pads <= 2) & ((F.length(body) + pads) % 4 == 0))
    ok = body.rlike("^[A-Za-z0-9+/_-]*$") & ~mixed & fits
    return F.when(ok, F.try_to_binary(F.translate(body, "-_", "+/"), F.lit("base64")))


def hex_encode(text: Column) -> Column:
    return F.lower(F.hex(F.encode(text, "UTF-8")))


def hex_decode(text: Column) -> Column:
    """Bytes of an even number of hexadecimal digits, else null (ENC-02)."""
    return F.when(text.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(text))


def _bytes(text: Column) -> Column:
    """Byte values of the UTF-8 text."""
    h = F.hex(F.encode(text, "UTF-8"))
    return F.transform(F.regexp_extract_all(h, F.lit("(..)"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("int"))


def binary_encode(text: Column) -> Column:
    """Groups of eight bits (ENC-04)."""
    return F.array_join(F.transform(_bytes(text), lambda b: F.lpad(F.bin(b), 8, "0")), " ")


def octal_encode(text: Column) -> Column:
    """Byte codes in base eight, unpadded (ENC-07)."""
    return F.array_join(F.transform(_bytes(text), lambda b: F.conv(b.cast("string"), 10, 8)), " ")


def decimal_encode(text: Column) -> Column:
    return F.array_join(F.transform(_bytes(text), lambda b: b.cast("string")), " ")


def _groups(text: Column) -> Column:
    return F.filter(F.split(text, "[\\t\\n\\x0B\\f\\r ]+"), lambda g: g != "")


def number_groups_decode(text: Column, base: int) -> Column:
    """Bytes of blank-separated numbers from 0 to 255 in the base (2: exactly eight digits); else null (ENC-04, ENC-07)."""
    shape = {2: "^[01]{8}$", 8: "^[0-7]{1,8}$", 10: "^[0-9]{1,8}$"}[base]
    g = _groups(text)
    value = lambda x: F.conv(x, base, 10).cast("int")
    ok = (F.size(g) > 0) & F.forall(g, lambda x: x.rlike(shape) & (F.when(x.rlike(shape), value(x)).otherwise(-1).between(0, 255)))
    return F.when(ok, F.unhex(F.array_join(F.transform(g, lambda x: F.lpad(F.conv(x, base, 16), 2, "0")), "")))


def url_encode(text: Column) -> Column:
    """Query escaping with + for a blank (ENC-05); Java leaves ``*`` and escapes ``~``, so both are put right."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_decode(text: Column) -> Column:
    """Null on a bad escape."""
    return F.try_url_decode(text)


def morse_encode(text: Column) -> Column:
    """Letters parted by blanks, words by `` / ``; other characters go (ENC-06)."""
    table = F.create_map(*[F.lit(x) for kv in MORSE.items() for x in kv])
    word = lambda w: F.array_join(F.filter(F.transform(F.split(w, ""), lambda c: F.try_element_at(table, c)), lambda c: c.isNotNull()), " ")
    return F.array_join(F.filter(F.transform(F.split(F.trim(F.lower(text)), "\\s+"), word), lambda w: w != ""), " / ")


def morse_decode(text: Column) -> Column:
    """Text of Morse code, unknown codes left out; null if no code is known."""
    table = F.create_map(*[F.lit(x) for c, m in MORSE.items() for x in (m, c)])
    known = lambda w: F.filter(F.transform(_groups(w), lambda c: F.try_element_at(table, c)), lambda c: c.isNotNull())
    words = F.transform(F.split(text, "/"), lambda w: F.array_join(known(w), ""))
    return F.when(F.exists(words, lambda w: w != ""), F.array_join(words, " "))


def leet_encode(text: Column) -> Column:
    """Letters that have a look-alike digit, in either case (ENC-08)."""
    return F.translate(text, "oieastbOIEASTB", "01345780134578")


def leet_decode(text: Column) -> Column:
    return F.translate(text, LEET_FROM, LEET_TO)


def looks_leet(word: Column) -> Column:
    """Some look-alikes, some letters, and no more of the former (ENC-08)."""
    marks, letters = F.regexp_count(word, F.lit("[0134578@$]")), F.regexp_count(word, F.lit("[A-Za-z]"))
    return (F.octet_length(word) >= 3) & (marks > 0) & (letters > 0) & (marks <= letters)


def xor_hex(text: Column, key: int) -> Column:
    """Hexadecimal of the bytes, each XORed with ``key`` (CIP-09)."""
    return F.array_join(F.transform(_bytes(text), lambda b: F.lpad(F.lower(F.hex(b.bitwiseXOR(F.lit(key)))), 2, "0")), "")
