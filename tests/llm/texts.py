"""Small corpora and plain definitions that the operators are compared with."""

import random
import re
from collections import Counter, defaultdict

ODD = [None, "", " ", "\n\t \r", "one", "One  two", "é" * 7, "a b c d e f g " * 400, "x" * 5000, "中文 中", "a\x0bb\x0cc"]


def corpus(seed, n=120, words=300, edits=(0, 0, 0.01, 0.03, 0.3)):
    """(doc_id, text): odd ones, then texts made from a few bases with copies, edits, shared passages and repeats."""
    rng = random.Random(seed)
    inventory = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    bases = [[rng.choice(inventory) for _ in range(rng.randint(1, words))] for _ in range(14)]
    passage = [rng.choice(inventory) for _ in range(90)]
    rows = list(enumerate(ODD + ODD[:4]))
    for doc_id in range(len(rows), n):
        own = list(rng.choice(bases[:2] if rng.random() < 0.4 else bases))
        for _ in range(int(len(own) * rng.choice(edits))):
            own[rng.randrange(len(own))] = rng.choice(inventory)
        if rng.random() < 0.3:
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage[rng.randrange(30) :]
        if rng.random() < 0.1:
            own += own[len(own) // 3 :]
        rows.append((doc_id, rng.choice([" ", "\n", "  "]).join(own)))
    return rows


def word_list(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def shingles(text, k):
    own = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in word_list(text)]
    if len(own) < k:
        return {tuple(own)} if own else set()
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}


def smallest(ids, links):
    """id -> smallest id that links reach."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    found = {}
    for start in sorted(ids):
        if start in found:
            continue
        found[start], open_ = start, [start]
        while open_:
            for other in near[open_.pop()]:
                if other not in found:
                    found[other] = start
                    open_.append(other)
    return found


def repeated_starts(texts, width):
    """Strings (or tuples) of `width` that start at two places or more."""
    counts = Counter(t[p : p + width] for t in texts for p in range(len(t) - width + 1))
    return {w for w, n in counts.items() if n > 1}
