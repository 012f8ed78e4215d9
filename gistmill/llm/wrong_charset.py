"""Text that was decoded with the wrong character set: finding it, and restoring what was written.

Characters are mapped back to the bytes of a legacy character set; an automaton over the byte structure of UTF-8 finds the
maximal well-formed multibyte spans, and only those are decoded. The automaton of each character set is compiled to one
pattern over its characters. A span counts only if what it decodes to is likely in running text: letters of the languages
at hand, punctuation and signs; letters of another script than their surroundings only in runs. Spans that decode to
spans again (text that went wrong twice) are decoded again.

Text of one single-byte set read as another one has no byte structure; there, words are mapped from one set to the other
and count if that turns them from impossible into words of one language (:func:`_written`) or script. U+FFFD stands for bytes that were
lost: it is found and can't be restored.

Defined results: NULL and empty values are never found and stay as they are; repeated rows are found each; other
columns are ignored; texts are searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Legacy sets that UTF-8 bytes are commonly read as, in the order in which they are tried (cp1252 stands for Latin-1 too).
SETS = ("cp1252", "cp1250", "iso8859-2", "cp1251", "cp437", "cp850", "mac_roman", "cp866", "cp1257")
LETTERS = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿŒœŸŠšŽžĄąĆćĘęŁłŃńŚśŹźŻżČčĎďĚěŇňŘřŤťŮůĞğİıŞşŐőŰűĂăȘșȚț"
SIGNS = "ƒˆ˜¡¢£¤¥¦§©ª«¬®¯°±²³´µ¶·¹º»¼½¾¿×÷‐‑‒–—―‘’‚“”„†‡•…‰′″‹›€№™Ω→←↑↓↔⇒∂∆∑−√∞≈≠≤≥─│┌┐└┘├┤┬┴┼═║█▪■□▲●○◦★☆☐☑☒✓✔✗✘ ​﻿   ⁠"
CYRILLIC = re.compile("[Ѐ-ЯЁа-яёіїєґІЇЄҐ]")
GREEK = re.compile("[ͰͿ-Ͽά-ώΑ-Ω]")
WIDE = re.compile("[ऀ-ॿ぀-ヿ一-鿿가-힯؀-ۿ֐-׿\U0001f300-\U0001faff☀-➿️]")


def _byte_table(name: str) -> dict[str, int]:
    """Character -> byte 0x80..0xFF of a set; bytes that the set leaves open are the C1 controls."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    if name == "cp1252":  # readers differ in the C1 range
        for b in range(0x80, 0xA0):
            table.setdefault(chr(b), b)
    return table


@lru_cache(maxsize=None)
def _automaton(name: str) -> tuple[re.Pattern, dict[str, int]]:
    """The pattern of maximal runs of well-formed multibyte sequences over a set's characters."""
    table = _byte_table(name)

    def chars(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in table.items() if low <= b <= high) + "]"

    tail = chars(0x80, 0xBF)
    sequences = (
        chars(0xC2, 0xDF) + tail,
        chars(0xE0, 0xE0) + chars(0xA0, 0xBF) + tail,
        chars(0xE1, 0xEC) + tail + tail,
        chars(0xED, 0xED) + chars(0x80, 0x9F) + tail,
        chars(0xEE, 0xEF) + tail + tail,
        chars(0xF0, 0xF0) + chars(0x90, 0xBF) + tail + tail,
        chars(0xF1, 0xF3) + tail + tail + tail,
    )
    return re.compile("(?:" + "|".join(s for s in sequences if "[]" not in s) + ")+"), table


@lru_cache(maxsize=None)
def _begins(*names: str) -> re.Pattern:
    """What every span of these sets begins with: a lead byte's character and one of a byte that follows."""
    tables = [_byte_table(name) for name in names]
    leads, tails = ("".join(re.escape(c) for c in sorted({c for t in tables for c, b in t.items() if low <= b <= high})) for low, high in ((0xC2, 0xF3), (0x80, 0xBF)))
    return re.compile(f"[{leads}][{tails}]")


def _likely(decoded: str, near: str, source: str, lone: bool) -> bool:
    """Whether a decoded span can be meant beside ``near``; ``lone``: single letters of other scripts may stand alone."""
    foreign = [c for c in decoded if c not in LETTERS and c not in SIGNS]
    if not foreign:
        return True
    if all(CYRILLIC.match(c) for c in foreign):
        return len(foreign) > 1 or lone or bool(CYRILLIC.search(near))
    if all(GREEK.match(c) for c in foreign):
        return len(foreign) > 1 or lone or source == "cp1252" and foreign[0] in "ΔΩΣΦαβγδεμπσφ"
    return all(WIDE.match(c) or CYRILLIC.match(c) or GREEK.match(c) for c in foreign) and (len(foreign) > 2 or ord(foreign[0]) >= 0x2600 and ord(foreign[0]) not in range(0x3000, 0x1F000))


def decode_spans(text: str, name: str, lone: bool = False) -> tuple[str, int]:
    """(``text`` with the likely spans of one set decoded, decoded characters)."""
    pattern, table = _automaton(name)
    hits = 0

    def decode(m: re.Match) -> str:
        nonlocal hits
        out = bytes(table[c] for c in m.group(0)).decode("utf-8", "replace")
        # text that went wrong twice decodes to spans of the same set
        if not pattern.search(out) and not _likely(out, text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1], name, lone):
            return m.group(0)
        hits += len(out)
        return out

    out = pattern.sub(decode, text)
    return decode_spans(text, name, True) if hits > 2 and not lone else (out, hits)


#: One byte read as another set: (read as, written as).
SINGLE = {"dos": ("cp437", "cp1252"), "cyrillic": ("cp1252", "cp1251"), "koi8": ("cp1251", "koi8-r"), "windows": ("koi8-r", "cp1251"), "polish": ("cp1252", "cp1250"), "latin-2": ("cp1252", "iso8859-2")}
# The letters of Russian from frequent to rare.
RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
_RANK = {c: k for k, c in enumerate(RUSSIAN)}
WORD = re.compile(r"[^\W\d_]+")
DOS_IN_WORD = re.compile("(?<=[A-Za-z])[αΓπΣσµτΦΘδ∞φε∩≡±≥≤⌠⌡÷≈°∙·√ⁿ■░▒▓│┤╡╢╖╕╣║╗╝╜╛┐└┴┬├─┼╞╟╚╔╩╦╠═╬╧╨╤╥╙╘╒╓╫╪┘┌█▄▌▐▀Æ£](?=[a-z])|(?<![A-Za-z0-9])[ΘΦΣτⁿφεδσ└▄┐╔╩╘╙╚╓╫╪╬](?=[a-z])|(?<=[a-z])[ΘτⁿΣφ▀](?![A-Za-z0-9])|(?<=[a-z])[ΘτⁿΣφ÷][αΓπΣσµτΦΘδφε▀÷](?=[a-z])")
DOS_SIGN = re.compile(r"▒(?=\d)|(?<=m)[▓│](?!\w)|(?<=\d)░(?=C)|(?<=\bn)░|(?<=\d )Ç(?!\w)|(?<= )[ûù](?= )(?! [a-z]+ [àâ])|^(?:[\s>|]*)[òα](?= )|(?<![\w ])α(?= )|(?<= )α(?= )|(?<=[a-z])Æ(?=s?\b)|(?<!\w)ô(?=\w+(?: \w+)*ö(?!\w))")
POLISH_IN_WORD = re.compile("(?<=[a-zóA-Z])[³¹¿](?=[a-zó¹ê])|[³¿]¹|œæ|(?<![\\w³¹])[³](?=[a-zó])|(?<=[a-zó])(?<!\\bm)(?<!\\b[cdkm]m)[³¹](?![\\w])|(?<![A-Za-z])[Œœ](?=[bcdfghjklmnprstwyz])|(?<=[a-zê])œ(?=[bcdfgjkmpwzæ])|(?<=[a-z])æ(?![\\w])|¿(?=[eêa][bcdfgjklmnprstwz]*[ ,.])(?<=[ ,]¿)")
LATIN2_IN_WORD = re.compile("(?<=[a-zó])[±¶¼](?=[a-zó³±æ])|(?<=[a-zó])[±¶](?![\\w])|(?<![\\w])¶(?=[a-z])")
C1_IN_WORD = re.compile("[a-zA-Z][\x80-\x9f]|[\x80-\x9f][a-zA-Z]")
HIGH_RUN = re.compile("[À-ÿ]{3,}")
CASE_TURNED = re.compile("(?<![А-Яа-яёЁ])[а-яё][А-ЯЁ╦]{2,}(?![а-яё])")
UPPER = re.compile("[А-ЯЁ╦Ј]{3,}")


def _map(text: str, read_as: str, written_as: str) -> str:
    """Every character of one set as what its byte is in another one."""
    return text.translate(_single_table(read_as, written_as))


@lru_cache(maxsize=None)
def _single_table(read_as: str, written_as: str) -> dict[int, str]:
    back = {b: c for c, b in reversed(_byte_table(written_as).items())}
    return {ord(c): back[b] for c, b in _byte_table(read_as).items() if b in back}


def _rarity(text: str) -> float:
    """Mean rank of the Russian letters of a text."""
    ranks = [_RANK[c] for c in text.lower() if c in _RANK]
    return sum(ranks) / len(ranks) if ranks else 99.0


# The characters without which a pattern above finds nothing.
_BLOCKS = frozenset(map(chr, range(0x2500, 0x25A1)))
_DOS = _BLOCKS | frozenset("αΓπΣσµτΦΘδ∞φε∩≡±≥≤⌠⌡÷≈°∙·√ⁿÆ£Çûùòôö")
_C1, _POLISH, _LATIN2 = frozenset(map(chr, range(0x80, 0xA0))), frozenset("³¹¿œæŒ"), frozenset("±¶¼")


def single_byte(line: str) -> tuple[str, str]:
    """(``line`` with one single-byte set put right, the kind), or the line and ``""``."""
    there = set(line)
    if max(there) >= "Ѐ" and CYRILLIC.search(line):
        turned, shouted = bool(CASE_TURNED.search(line)), "".join(UPPER.findall(line))
        if turned or len(shouted) >= 5:
            best = min(("koi8", "windows"), key=lambda kind: _rarity(_map(line, *SINGLE[kind])))
            mapped = _map(line, *SINGLE[best])
            if turned or _rarity(mapped) + 2.5 < _rarity(line):
                return mapped, best
        return _written(line)
    if not _C1.isdisjoint(there) and C1_IN_WORD.search(line):
        return _map(line, "cp1252", "cp850"), "dos as windows"
    for run in HIGH_RUN.findall(line):
        mapped = _map(run, *SINGLE["cyrillic"])
        if all(CYRILLIC.match(c) for c in mapped) and _rarity(mapped) < 14:
            return WORD.sub(lambda m: _map(m.group(0), *SINGLE["cyrillic"]) if not m.group(0).isascii() else m.group(0), line.replace("÷", "\u0447").replace("¸", "ё")), "cyrillic"
    written, kind = _written(line)
    if kind:
        return written, kind
    if not _DOS.isdisjoint(there) and (DOS_IN_WORD.search(line) or DOS_SIGN.search(line)):
        return _map(line, *SINGLE["dos"]), "dos"
    if not _POLISH.isdisjoint(there) and POLISH_IN_WORD.search(line):
        return _map(line, *SINGLE["polish"]), "polish"
    if not _LATIN2.isdisjoint(there) and LATIN2_IN_WORD.search(line):
        return _map(line, *SINGLE["latin-2"]), "latin-2"
    return line, ""


#: Single-byte sets that were confused: (read as, written as), tried in this order.
CONFUSED = (
    ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp1257", "cp1252"), ("cp1251", "cp1252"),
    ("cp866", "cp1252"), ("cp1252", "cp1257"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1250", "cp1252"),
)
# The letters beyond a to z of languages in Latin script, by the part of Europe whose set has them.
WEST = ("äöüß", "àâæçéèêëîïôœùûüÿ", "áéíñóúü", "àáâãçéêíóôõú", "àèéìòùî", "éëïóöü", "åäöé", "æøåé")
MIDDLE = ("ąćęłńóśźż", "áčďéěíňóřšťúůýž", "áäčďéíĺľňóôŕšťúýž", "áéíóöőúüű", "ăâîșțşţ")
BALTIC = ("ąčęėįšųūž", "āčēģīķļņšūž", "äõöüšž")
_FITS = {name: [frozenset(x) for x in MIDDLE if name in ("cp1250", "iso8859-2")] + [frozenset(x) for x in BALTIC if name == "cp1257"] or [frozenset(x) for x in WEST] for name in {w for _, w in CONFUSED}}
#: Signs that people write inside words.
_INSIDE = frozenset("’‘ʼ´`‐‑–—·•…\xad\u200b\u200c\u200d\u2060\ufeff")
ODD_WORD = re.compile(r"[^\s\x21-\x40\x5b-\x60\x7b-\x7e]*[^\x00-\x7f][^\s\x21-\x40\x5b-\x60\x7b-\x7e]*")


def _impossible(word: str) -> bool:
    """Whether a word has a sign or a capital inside, or letters of two scripts, where none is written."""
    if not any(c.isalpha() and c.isascii() for c in word):
        return False
    if any(c > "ʯ" and c.isalpha() and CYRILLIC.match(c) for c in word):
        return True
    letters = [k for k, c in enumerate(word) if c.isalpha()]
    for k in range(letters[0] + 1, letters[-1] + 1):
        c = word[k]
        if not c.isascii() and c not in _INSIDE and (not (c.isalpha() or c.isdecimal()) or c < "ɐ" and c.isupper() and word[k - 1].islower()):
            return True
    return False


def _written(line: str) -> tuple[str, str]:
    """(``line`` as one other set has it, the pair of sets) if that turns impossible words into words of one language, else the line and ``""``."""
    odd = ODD_WORD.findall(line)
    if not any(map(_impossible, odd)):
        return line, ""
    best, least = (line, ""), 1 << 30
    for read_as, written_as in CONFUSED:
        table = _single_table(read_as, written_as)
        out = line.translate(table)
        if out == line or not all(ord(c) in table for w in odd for c in w if not c.isascii() and c.isalpha()):
            continue
        words = ODD_WORD.findall(out)
        if any(map(_impossible, words)):
            continue
        # within words nothing but letters of one language may be left, and the fewer the better
        letters = [c for w in words if any(x.isascii() and x.isalpha() for x in w) for c in w.lower() if not c.isascii() and c not in _INSIDE]
        if not letters and any(c not in "’‘" and not c.isascii() for w in words if any(x.isascii() and x.isalpha() for x in w) for c in w.strip("’‘“”–—…")):
            continue
        if len(letters) < least and any(fit.issuperset(letters) for fit in _FITS[written_as]):
            best, least = (out, f"{written_as} as {read_as}"), len(letters)
    return best


#: Where any of the rules above can begin: neighbours beyond ASCII, a sign or capital behind a letter, two scripts in a word, or a
#: character that the rules for single signs name. One fast scan; what it passes over no rule would change.
_START = re.compile(
    r"[^\x00-\x7f](?:[^\x00-\x7f]|(?<=[\x80-\x9f\ufffdαΓπΣσµτΦΘδ∞φε∩≡≥≤⌠⌡≈∙√ⁿ■▀-▟─-╿³¹¶¼ŒœÆæòùûÇ·÷°±¿£ô])|(?<=[a-zß-ÿ][À-ÖØ-ÞĀ-ɏ])"
    r"|(?<=[^\W\d_][^\x00-\x7f\w’‘ʼ–—‐‑•…])|(?<=[A-Za-z][Ѐ-ӿ])|(?<=[Ѐ-ӿ])[A-Za-z])"
)


def restore(text: str | None) -> tuple[str | None, bool]:
    """(the text as it was written as far as that can be had, whether something was wrong)."""
    if not text or not _START.search(text):
        return text, False
    lines, wrong = text.split("\n"), False
    for k, line in enumerate(lines):
        if not _START.search(line):
            continue
        wrong |= "\ufffd" in line
        for _ in range(3):
            if not _begins(*SETS).search(line):
                break
            options = [decode_spans(line, name) for name in SETS if _begins(name).search(line)]
            best, most = max(options, key=lambda x: x[1], default=(line, 0))
            if not most:
                break
            line, wrong = best, True
        line, kind = single_byte(line)
        wrong |= bool(kind)
        lines[k] = line
    return "\n".join(lines), wrong


def wrong_fields(emails: DataFrame, fields: tuple[str, ...] = ("subject", "body"), key: str = "idx") -> DataFrame:
    """``idx, field, restored`` of each field that holds wrongly decoded text; no shuffle."""
    rows = emails.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("f"))
    rows = rows.select(key, "f.field", "f.text").where(F.col("text").rlike(r"[^\x00-\x7f]"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [restore(t) for t in batch.column("text").to_pylist()]
            kept = pa.array([k for k, (_, wrong) in enumerate(done) if wrong], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(kept), batch.column("field").take(kept), pa.array([t for t, wrong in done if wrong], pa.string())], [key, "field", "restored"])

    return rows.mapInArrow(search, f"{key} {emails.schema[key].dataType.simpleString()}, field string, restored string")
