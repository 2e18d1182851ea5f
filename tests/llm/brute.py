"""Plain single-threaded versions of the operators' contracts."""
import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def substring_words(rows, window):
    """rows: (id, text). Returns (id, n_words, n_removed, sha of kept)."""
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if count[tuple(w[p:p + window])] > 1:
                gone[p:p + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def substring_bytes(rows, window):
    """Returns (id, n_bytes, n_removed, n_spans, sha of kept)."""
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(b[i:i + window] for b in texts for i in range(len(b) - window + 1))
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        gone = [False] * len(b)
        for p in range(len(b) - window + 1):
            if count[b[p:p + window]] > 1:
                gone[p:p + window] = [True] * window
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def decontaminate(rows, items, window=10):
    """Returns (id, n_words, n_hit, n_items, sha of items, contaminated)."""
    wins = {}
    for i, t in items:
        w = ALNUM.findall(lower_ascii(t))
        for p in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[p:p + window]), set()).add(i)
    sizes = {len(w) for w in wins}
    out = []
    for i, t in rows:
        w = ALNUM.findall(lower_ascii(t))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (x := wins.get(tuple(w[p:p + n]))) is not None:
                    hit[p:p + n] = [True] * n
                    found |= x
        found = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), sum(hit), len(found), sha(",".join(found)), any(hit)))
    return out


def quality_counts(t):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    count = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = set()
    for i in range(len(w) - 2):
        if count[tuple(w[i:i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def shingle_weights(t, size=5):
    w = WORD.findall(t or "")
    return Counter(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def jaccard(a, b):
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 0.0


def near_classes(rows, threshold=0.8):
    """Least id of the class of each row (rows with the same id must have the same text)."""
    texts = sorted({t for _, t in rows if WORD.search(t or "")})
    sets = [shingle_weights(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if jaccard(a, sets[j]) >= threshold:
                root[find(i)] = find(j)
    at = {t: find(i) for i, t in enumerate(texts)}
    key = lambda i: (i is not None, i)
    least = {}
    for i, t in rows:
        if t in at:
            c = at[t]
            least[c] = min(least.get(c, key(i)), key(i), key=lambda x: (x[0], x[1] or 0))
    return [(i, least[at[t]][1] if t in at else i) for i, t in rows]
