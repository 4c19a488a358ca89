"""Problem 6: text that was decoded with the wrong character encoding.

Round-trip repair: a stretch of text is re-encoded under a candidate legacy
encoding (the one it was wrongly read with), strictly decoded as the encoding
that was intended, and the step is repeated for nested layers.  A step is kept
only when a garbling cost drops.

Defined results: null or blank content is no case; content without any
character beyond ASCII is no case and never leaves the JVM; characters replaced
by U+FFFD (or deleted bytes that left such marks) cannot be had back, so the
restored hash is an empty string.  Repeated rows give repeated results; extra
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings a text may have been read with by mistake.
WRONG = ("cp1252", "latin-1", "cp1251", "cp1250", "cp437", "mac_roman", "iso8859-15", "cp850")
#: Single-byte and double-byte encodings a text may really have had, beside UTF-8.
INTENDED = ("iso8859-2", "cp1250", "cp1251", "koi8-r", "gb18030", "shift_jis", "euc-jp", "big5", "euc-kr", "iso8859-7", "cp1253", "iso8859-9", "cp866")

_HIGH = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"[^\W\d_]*[^\x00-\x7f][^\s\x00-\x2c\x2e-\x40\x5b-\x60\x7b-\x7f]*")


def _byte_of(ch: str, codec: str) -> bytes | None:
    try:
        return ch.encode(codec)
    except UnicodeEncodeError:
        # the five bytes that cp125x leaves undefined pass through as C1 controls
        return bytes([ord(ch)]) if codec.startswith("cp125") and 0x80 <= ord(ch) <= 0x9F else None


@lru_cache(maxsize=1 << 16)
def _reencode(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        if not codec.startswith("cp125"):
            return None
    parts = [_byte_of(c, codec) for c in text]
    return None if None in parts else b"".join(parts)


@lru_cache(maxsize=1 << 16)
def _script(ch: str) -> str:
    if ch < "\x80":
        return "LATIN" if ch.isalpha() else "COMMON"
    name = unicodedata.name(ch, "")
    head = name.split(" ", 1)[0]
    if not ch.isalpha():
        return "COMMON"
    if head in ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA"):
        return "HAN"
    return head


#: Letters that occur in the Latin alphabets of Europe, by rough frequency: the more common are cheap.
_COMMON_LATIN = set("áàâäãåæçéèêëíìîïñóòôöõøœúùûüýßÁÀÂÄÃÅÆÇÉÈÊËÍÎÏÑÓÔÖÕØÚÙÛÜ" "ąćęłńóśźżĄĆĘŁŃŚŹŻ" "čďěňřšťůžČĎĚŇŘŠŤŮŽ" "őűŐŰ" "ăâîșțşţĂÂÎȘȚŞŢ" "ğıİĞ" "đĐ" "āēģīķļņūĀĒĢĪĶĻŅŪ" "ėįųĖĮŲ" "ľĺŕĽ")
_TYPO = set("–—‘’‚“”„…•€™«»°§©®×÷½¼¾±µ·¿¡ºª№→←≤≥≠ ′″²³¶")
#: Frequent Chinese and Japanese characters; text that is really such is full of them.
_HAN_LOW, _HAN_HIGH = 0x4E00, 0x9FFF


#: A lead byte of two-byte UTF-8 as cp1252 shows it, and what cp1252 shows of the byte that follows one.
_PAIR = re.compile("[ÂÃÄÅÎÏÐÑ][\u00a0-\u00bf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")


def garbling_cost(text: str) -> float:
    """How garbled a stretch looks: 0 for clean text of any script, growing with impossible neighbours."""
    cost = 1.0 * len(_PAIR.findall(text))
    for m in _WORD.finditer(text):
        word = m.group()
        letters = [c for c in word if c.isalpha()]
        scripts = {_script(c) for c in letters}
        high = [c for c in word if c > "\x7f"]
        for k, c in enumerate(word):
            if c <= "\x7f":
                continue
            if c == "�" or unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs"):
                cost += 4
            elif c == "­":
                cost += 2
            elif not c.isalpha() and not unicodedata.category(c).startswith("M"):
                before = word[k - 1] if k else " "
                after = word[k + 1] if k + 1 < len(word) else " "
                if c in "’'" and before.isalpha() and after.isalpha():
                    continue
                if c in "·" and before.isalpha():
                    continue
                if c in "。、，！？：；（）「」『』《》・ー・…—“”‘’" and _script(before) in ("HAN", "HANGUL"):
                    continue
                if c in _TYPO and not (before.isalpha() and after.isalpha()) and not (before > "\x7f" and after > "\x7f"):
                    if before > "\x7f" and before.isalpha() and _script(before) == "LATIN" and (c not in "’”…»“‘–—" or before in "ÃÂâãÐÑåæç"):
                        cost += 1.5
                    continue
                cost += 2 if before > "\x7f" or after > "\x7f" or before.isalpha() else 0.5
            elif _script(c) == "LATIN" and c not in _COMMON_LATIN:
                cost += 1.2
            elif _script(c) not in ("LATIN", "CYRILLIC", "GREEK", "HAN", "HANGUL", "ARABIC", "HEBREW", "THAI", "DEVANAGARI"):
                cost += 1.5
            elif _script(c) == "CYRILLIC" and not ("А" <= c <= "я" or c in "ёЁіІїЇєЄґҐўЎ"):
                cost += 1.5
            elif _script(c) == "HAN" and not (_HAN_LOW <= ord(c) <= _HAN_HIGH or 0x3040 <= ord(c) <= 0x30FF or c == "々"):
                cost += 1.5
        if len(scripts) > 1:
            cost += 2 * (len(scripts) - 1) + 0.5 * min(len([c for c in letters if c <= "\x7f"]), len(high))
        if scripts == {"LATIN"} and len(high) > 2 and len(high) > 0.6 * len(word):
            cost += 1.0 * len(high)
        if len(letters) > 2:
            # a lower-case letter followed by an upper-case accented one inside a word
            cost += sum(1.5 for a, b in zip(word, word[1:]) if b > "\x7f" and a.isalpha() and a.islower() and b.isupper() and _script(a) == _script(b))
    return cost


@lru_cache(maxsize=1 << 15)
def _as_utf8(run: str) -> str | None:
    """The run read as it was meant, if it is UTF-8 read under a legacy encoding; layers are undone in turn.

    A layer between may hold control characters (bytes the wrong encoding leaves undefined); the result may not.
    """
    now, done = run, None
    while True:
        # each step makes the text shorter, so there is an end
        step = None
        for codec in WRONG:
            raw = _reencode(now, codec)
            if raw is None or len(raw) < 2:
                continue
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(text) < len(now):
                step = text
                break
        if step is None:
            break
        now = step
        if not any("\x80" <= c <= "\x9f" for c in now):
            done = now
        if now.isascii():
            break
    return done


def _utf8_runs(line: str) -> str:
    """Restores every stretch of the line that is UTF-8 in disguise, if the cost drops by one of them at least."""
    drops = False
    for m in _HIGH.finditer(line):
        text = _as_utf8(m.group())
        if text is None or "\ufffd" in text:
            continue
        before, after = line[max(0, m.start() - 12) : m.start()], line[m.end() : m.end() + 12]
        if garbling_cost(before + text + after) < garbling_cost(before + m.group() + after):
            drops = True
            break
    if not drops:
        return line
    return _HIGH.sub(lambda m: t if (t := _as_utf8(m.group())) is not None and "\ufffd" not in t else m.group(), line)


def _legacy_line(line: str) -> str:
    """Restores a line whose bytes were in a legacy encoding but read as another; the best drop of cost decides."""
    had = garbling_cost(line)
    if had < 1.5:
        return line
    best, text = had, line
    for wrong in WRONG:
        raw = _reencode(line, wrong)
        if raw is None:
            continue
        for codec in INTENDED:
            if codec == wrong:
                continue
            try:
                t = raw.decode(codec)
            except UnicodeDecodeError:
                continue
            if t == line:
                continue
            now = garbling_cost(t)
            if codec in ("gb18030", "shift_jis", "euc-jp", "big5", "euc-kr"):
                now += _unlikely_han(t, codec in ("shift_jis", "euc-jp"))
            if now < best - 0.01:
                best, text = now, t
    return text if best <= 0.35 * had else line


@lru_cache(maxsize=1 << 14)
def _rare(ch: str) -> bool:
    """GB2312 level 1 or JIS level 1: the frequent half of the characters, as those standards rank them."""
    try:
        b = ch.encode("gb2312")
        if len(b) == 2 and (b[0] < 0xD8):
            return False
    except UnicodeEncodeError:
        pass
    try:
        b = ch.encode("shift_jis")
        return not (len(b) == 2 and b[0] < 0x98 or len(b) == 1)
    except UnicodeEncodeError:
        return True


def _unlikely_han(text: str, japanese: bool) -> float:
    """Cost of rare characters, and of kana where the encoding is Chinese, or of none where it is Japanese."""
    high = [c for c in text if c > "\x7f"]
    kana = sum("\u3040" <= c <= "\u30ff" for c in high)
    return sum(0.8 for c in high if _rare(c)) + (0.5 if len(high) < 3 else 0) + (0 if japanese == (kana > 0) else 0.6 * max(kana, 2))


def _quoted(line: str, fixed: str) -> bool:
    """A line that shows a garbled sequence beside its right form quotes it on purpose."""
    old, new = _HIGH.findall(line), _HIGH.findall(fixed)
    if len(old) != len(new):
        return False
    right = {b for a, b in zip(old, new) if a == b}
    return any(a != b and b in right for a, b in zip(old, new))


@lru_cache(maxsize=1 << 15)
def restore_line(line: str) -> str:
    """The line as it was before it was garbled, or the same line.

    Both kinds of step are tried in turn for as long as the cost drops, so that
    a layer of either kind under one of the other is undone as well.
    """
    if line.isascii():
        return line
    now, cost = line, garbling_cost(line)
    while True:
        utf8 = _utf8_runs(now)
        if _quoted(now, utf8):
            return now
        legacy = _legacy_line(now)
        new = utf8 if utf8 != now and garbling_cost(utf8) <= garbling_cost(legacy) else legacy
        left = garbling_cost(new)
        if new == now or now is not line and left >= cost:
            return now
        now, cost = new, left


def restore(content: str) -> tuple[bool, str]:
    """(is a case, restored content or an empty string if characters are lost for good)."""
    lost, changed, out = False, False, []
    for line in content.split("\n"):
        if line.isascii():
            out.append(line)
            continue
        if "�" in line and _lost(line):
            lost = True
        new = restore_line(line)
        changed |= new != line
        out.append(new)
    if lost:
        return True, ""
    return changed, "\n".join(out) if changed else ""


def _lost(line: str) -> bool:
    """Replacement characters that stand for text, not ones named or quoted as such."""
    return not re.search(r"(['\"`])�{1,2}\1", line) and not re.search(r"(?i)replacement[ _-]?(?:char|mark|glyph|symbol|code)|u\+?fffd", line)


def restored_files(files: DataFrame) -> DataFrame:
    """``id, restored`` of each row of ``files(id, content)`` that holds wrongly decoded text: the whole content as it was, null if characters are lost for good.

    Narrow: one scan, no shuffle.  The JVM-side filter keeps ASCII-only rows away from Python.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, text or None) for i, (case, text) in zip(pdf["id"], map(restore, pdf["content"])) if case]
            yield pd.DataFrame(rows, columns=["id", "restored"])

    some = files.select("id", "content").where(F.col("content").rlike(r"[^\x00-\x7F]"))
    return some.mapInPandas(run, "id bigint, restored string")


def garbled_files(files: DataFrame) -> DataFrame:
    """``id, restored_sha``: the SHA-256 of each restored content, an empty string where it cannot be had."""
    return restored_files(files).select("id", F.coalesce(F.sha2("restored", 256), F.lit("")).alias("restored_sha"))
