"""Plain Python versions that the operators are compared with."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None, width: int) -> set:
    words = WORD.findall(lower(text))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def components(rows: list[tuple], width: int, percent: int = 80) -> dict:
    """doc_id -> (set size, smallest id of its component, whether it is that one)."""
    sets = {i: shingles(text, width) for i, text in rows}
    holders, parent = collections.defaultdict(list), {i: i for i in sets}
    for i, found in sets.items():
        for one in found:
            holders[one].append(i)

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, found in sets.items():
        for j, shared in collections.Counter(j for one in found for j in holders[one] if j < i).items():
            if 100 * shared >= percent * (len(found) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def repeated(rows: list[tuple], size: int = 50) -> dict[int, set]:
    """doc_id -> word positions in runs of `size` words that a document of a smaller id holds."""
    first, found = {}, collections.defaultdict(set)
    for i, text in sorted(rows):
        words = WORD.findall(lower(text))
        for k in range(len(words) - size + 1):
            run = tuple(words[k : k + size])
            if first.setdefault(run, i) != i:
                found[i].update(range(k, k + size))
    return found


def fits(item: str, text: str | None, edits: float = 0.2) -> bool:
    """Whether some run of the text's words is within `edits` of the item's words."""
    item, words = WORD.findall(lower(item)), WORD.findall(lower(text))
    row = [0] * (len(words) + 1)
    for i, word in enumerate(item):
        new = [i + 1]
        for j, other in enumerate(words):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (word != other)))
        row = new
    return min(row) <= edits * len(item)


def bpe(tokenizer, text: str | None) -> tuple:
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def phrases(text: str | None) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def vocabulary(rows: list[tuple]) -> dict[str, int]:
    """Words of at least 5 letters and 3 occurrences, one in 97 of a text's words without a letter."""
    total = collections.Counter()
    for i, text in rows:
        for word in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            word = lower(word)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return {word: n for word, n in total.items() if len(word) >= 5 and n >= 3}
