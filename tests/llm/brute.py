"""Plain Python forms of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def windows_removed(rows, window):
    """[(id, n_words, n_removed, sha)] in the order of rows of (id, text); the id None is the greatest."""
    key = lambda i: (i is None, i or 0)
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, words in docs:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            least[w] = min(least.get(w, key(i)), key(i))
    out = []
    for i, words in docs:
        gone = set()
        for k in range(len(words) - window + 1):
            if least[tuple(words[k : k + window])] < key(i):
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def strings_removed(rows, length):
    """[(id, n_bytes, n_removed, n_spans, sha)]; ids are distinct."""
    docs = sorted((i, (t or "").encode()) for i, t in rows)
    seen, out = set(), {}
    for i, data in docs:
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            else:
                seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = (i, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return [out[i] for i, _ in rows]
