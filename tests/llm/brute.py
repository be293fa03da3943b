"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def stats(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def dedup_lines(docs, units=8):
    """[(doc_id, text)] to {doc_id: (lines, removed lines, new text)}; doc_ids are unique here."""
    first = {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        for no, line in enumerate((text or "").split("\n")):
            if WORD.search(line):
                first.setdefault(line, (doc_id, no))
    ordered = sorted(first, key=first.get)
    gone = set()
    by_words, by_chars = defaultdict(list), defaultdict(list)
    for x in ordered:
        words, chars = x.split(" "), list(x)
        n, m = len(words), len(chars)
        near = any(one_edit(words, y) for k in (n - 1, n, n + 1) for y in by_words[k] if max(k, n) >= units)
        if near or n < units and any(one_edit(chars, y) for k in (m - 1, m, m + 1) for y in by_chars[k] if max(k, m) >= units):
            gone.add(x)
        by_words[n].append(words)
        if n < units:
            by_chars[m].append(chars)
    out = {}
    for doc_id, text in docs:
        if text is None:
            out[doc_id] = (0, 0, None)
            continue
        lines = text.split("\n")
        real = [x for x in lines if WORD.search(x)]
        stay = [x for no, x in enumerate(lines) if not WORD.search(x) or (first[x] == (doc_id, no) and x not in gone)]
        n = len([x for x in stay if WORD.search(x)])
        out[doc_id] = (len(real), len(real) - n, "\n".join(stay))
    return out


def shingle_set(text, words):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def near_groups(docs, words=2, similarity=80):
    """[(doc_id, text)] to {doc_id: (n_shingles, component_id)}."""
    sets = {i: shingle_set(t, words) for i, t in docs}
    by_shingle = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in by_shingle[x] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n) and similarity == 80:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def contamination(docs, items, window=10):
    patterns = defaultdict(set)
    for item_id, text in items:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            patterns[tuple(w[i : i + window])].add(str(item_id))
    sizes = {len(p) for p in patterns}
    out = {}
    for doc_id, text in docs:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in patterns:
                    hit.update(range(i, i + n))
                    found |= patterns[p]
        out[doc_id] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def repeated_bytes(docs, length=50):
    """[(doc_id, text)] to {doc_id: (n_bytes, n_removed, n_spans, kept bytes)}; doc_ids are unique here."""
    seen = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            seen[s] = min(seen.get(s, i), i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] < i:
                cover[k : k + length] = b"\1" * length
        kept = bytes(c for c, x in zip(b, cover, strict=True) if not x)
        spans = len(re.findall(rb"\x01+", bytes(cover)))
        out[i] = (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return out


def maximal_chats(rows):
    """[(conv_id, turn, role, text)] to {conv_id: turns} of the conversations that stay."""
    chats = defaultdict(set)
    for conv, turn, role, text in rows:
        chats[conv].add((turn, role, text))
    lists = {c: [(r, t) for _, r, t in sorted(x)] for c, x in chats.items()}
    stay = {}
    for c, x in lists.items():
        longer = any(len(y) > len(x) and y[: len(x)] == x for y in lists.values())
        equal = min(d for d, y in lists.items() if y == x)
        if not longer and equal == c:
            stay[c] = x
    return stay
