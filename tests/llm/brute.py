"""Plain versions of what the operators compute, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

UPPER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def repeats(texts, length):
    """Of each text the mask of its bytes under strings that start elsewhere too."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    masks = []
    for b in bodies:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        masks.append(mask)
    return bodies, masks


def fingerprint(text, shingle=3):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps, limit=2):
    """Least id that each reaches over links."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i in range(len(fps)):
        least[root(i)].append(ids[i])
    return [min(least[root(i)]) for i in range(len(fps))]


def contamination(text, items, window=10):
    words = [w for w in ITEM_WORD.findall((text or "").translate(UPPER))]
    hit, named = [False] * len(words), set()
    for item_id, item in items:
        ws = ITEM_WORD.findall((item or "").translate(UPPER))
        for a in range(max(1, len(ws) - window + 1) if ws else 0):
            win = ws[a : a + window]
            for i in range(len(words) - len(win) + 1):
                if words[i : i + len(win)] == win:
                    hit[i : i + len(win)] = [True] * len(win)
                    named.add(str(item_id))
    return len(words), sum(hit), sorted(named)


def fold_line(line):
    return " ".join(WORD.findall(line.translate(UPPER)))


def quality(rows, limit, share):
    """rows: (text, host). Of each: the measures, whether base rules fail, whether it is kept, its text without the removed lines."""
    lines = [[x for x in (t or "").split("\n") if WORD.search(x)] for t, _ in rows]
    hashed = [[hashlib.md5(fold_line(x).encode()).hexdigest()[:16] for x in ls] for ls in lines]
    holders = defaultdict(set)
    for (text, host), hs in zip(rows, hashed, strict=True):
        for h in hs:
            holders[host or "", h].add(text)
    out = []
    for (text, host), ls, hs in zip(rows, lines, hashed, strict=True):
        ws = WORD.findall(text or "")
        wins = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        n = Counter(wins)
        covered = {i + k for i, w in enumerate(wins) if n[w] > 1 for k in range(3)}
        gone = {h for h in hs if len(holders[host or "", h]) > limit}
        removed = sum(len(WORD.findall(x)) for x, h in zip(ls, hs, strict=True) if h in gone)
        failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
        kept = not failed and len(ws) - removed >= share * len(ws)
        left = "\n".join(x for x in (text or "").split("\n") if not WORD.search(x) or hashlib.md5(fold_line(x).encode()).hexdigest()[:16] not in gone)
        out.append((len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(covered), failed, kept, left if gone else text))
    return out
