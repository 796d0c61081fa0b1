"""Plain Python versions of operators, one text at a time, from the texts alone."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import xxhash

from parlance.llm import common, langid, toxicity

ALL = (1 << 64) - 1


def fold(doc_id, modulus):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def words(text):
    """Words in lower case (A-Z only), as bytes."""
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & ALL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & ALL
    return x ^ (x >> 31)


_BYTE, _PLACE = [int(x) for x in common._BYTE], [int(x) for x in common._PLACE]


@lru_cache(None)
def word_hash(word):
    total, power = 0, 1
    for b in word:
        total, power = total + _BYTE[b] * power, power * common._BASE & ALL
    return mix(total & ALL)


# ---------------------------------------------------------------- toxicity


def toxic_slots(text):
    """The distinct slots of words, pairs and skip-pairs, as they stand and without punctuation at the ends."""
    said = words(text)
    junk = bytes(b for b in range(128) if not chr(b).isalnum())
    bare = [w.strip(junk) or w for w in said]
    out = set()
    for of, fresh in ((said, [True] * len(said)), (bare, [a != b for a, b in zip(said, bare, strict=True)])):
        h = [word_hash(w) for w in of]
        for gap in (0, 1, 2):
            for i in range(len(h) - gap):
                if fresh[i] or fresh[i + gap]:
                    x = h[i] if not gap else mix((h[i] * _PLACE[0] + h[i + 1] * _PLACE[1]) & ALL) if gap == 1 else mix((h[i] * 3 + h[i + 2] * int(toxicity._SKIP)) & ALL)
                    out.add(x >> int(toxicity._SHIFT))
    return sorted(out)


def toxic_scores(docs, labels):
    """The score of each of ``docs`` [(doc_id, text)] after learning from ``labels`` [(doc_id, toxic)]."""
    slots = [toxic_slots(text) for _, text in docs]
    z, n = defaultdict(float), defaultdict(float)
    bias = toxicity.SLOTS
    z[bias] = -math.log(toxicity.PRIOR / (1 - toxicity.PRIOR)) * (toxicity.BETA / toxicity.ALPHA + toxicity.L2)

    def weight(s):
        if s not in z:
            return 0.0
        pull = 0.0 if s == bias else toxicity.L1
        return 0.0 if abs(z[s]) <= pull else -math.copysign(abs(z[s]) - pull, z[s]) / ((toxicity.BETA + math.sqrt(n[s])) / toxicity.ALPHA + toxicity.L2)

    def guess(of):
        return 1 / (1 + math.exp(-min(35, max(-35, math.fsum(weight(s) for s in (*of, bias))))))

    def key(doc_id):
        x = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), seed=42)
        return x - (1 << 64) if x >> 63 else x

    rows = sorted((key(i), y, np.array(s, np.int32).tobytes()) for (i, _), s in zip(docs, slots, strict=True) for j, y in labels if i == j and i is not None and y is not None and fold(j, 5) != 0)
    for epoch in range(toxicity.EPOCHS):
        for at in sorted(range(len(rows)), key=lambda r: mix(r + (epoch << 32))):
            used, y = [*np.frombuffer(rows[at][2], np.int32).tolist(), bias], rows[at][1]
            g = guess(used[:-1]) - y
            for s, w in [(s, weight(s)) for s in used]:
                z[s] += g - (math.sqrt(n[s] + g * g) - math.sqrt(n[s])) / toxicity.ALPHA * w
                n[s] += g * g
    return [guess(s) for s in slots]


# ---------------------------------------------------------------- language


class Languages:
    """Unit text vectors and the prototypes of ``docs`` [(doc_id, text, lang)]."""

    def __init__(self, docs):
        self.letters, self.bound, sums = langid.Encoder().letter, {}, {}
        for i, text, lang in docs:
            v = self.vector(text)
            if lang is not None and v is not None and fold(i, 4) != 2:
                sums[lang] = sums.get(lang, 0) + v
        self.model = {k: v / np.sqrt(v @ v) for k, v in sums.items()}

    def vector(self, text):
        low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
        if not low.strip(" "):
            return None
        low = " " + " ".join(x for x in low.split(" ") if x) + " "
        total = np.zeros(langid.DIMS)
        for gram, n in Counter(low[i : i + 3] for i in range(len(low) - 2)).items():
            if gram not in self.bound:
                self.bound[gram] = np.prod([np.roll(self.letters(ord(c)), place) for place, c in enumerate(gram)], axis=0)
            total += n * self.bound[gram].astype(float)
        return total / np.sqrt(total @ total)

    def guess(self, text):
        """(language, cosine), or (None, 0) without a letter."""
        v = self.vector(text)
        if v is None:
            return None, 0.0
        best = max(sorted(self.model), key=lambda k: self.model[k] @ v)
        return best, float(self.model[best] @ v)


# ---------------------------------------------------------------- near duplicates


def shingles(text, n=5):
    said = words(text)
    return {tuple(said[i : i + n]) for i in range(len(said) - n + 1)} if len(said) >= n else {tuple(said)} - {()}


def component_of(docs, percent=80):
    """doc_id -> smallest doc_id that links reach, over all pairs of ``docs`` [(doc_id, text)]."""
    sets, up = {i: shingles(text) for i, text in docs}, {i: i for i, _ in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and x and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                up[high] = low
    return {i: root(i) for i in ids}


# ---------------------------------------------------------------- mixing


def copies(docs, max_repeats=2.0):
    """How often each of ``docs`` [(doc_id, text, source)] is used, in their order."""
    tokens = defaultdict(int)
    for _, text, source in docs:
        tokens[source] += len(words(text))
    whole = sum(tokens.values())

    def uses(a):
        raw = {s: (t / whole) ** a for s, t in tokens.items() if t}
        weight = {s: x / sum(raw.values()) for s, x in raw.items()}
        run = max(tokens[s] / w for s, w in weight.items())
        return {s: run * w for s, w in weight.items()}

    low, high = -1.0, 1.0  # the smallest exponent from 0 on that repeats no source too often
    for _ in range(80):
        a = max(0.0, (low + high) / 2)
        if all(u <= max_repeats * tokens[s] * (1 + 1e-12) for s, u in uses(a).items()):
            high = a
        else:
            low = a
        if high == 0.0:
            break
    wanted = {s: round(u) for s, u in uses(high).items()}
    out, running = [1] * len(docs), defaultdict(int)
    for s, want in wanted.items():
        passes, part = divmod(want, tokens[s])
        mine = [k for k, d in enumerate(docs) if d[2] == s]
        key = {k: hashlib.md5(f"mix-1:{passes}:{'' if docs[k][0] is None else docs[k][0]}".encode()).hexdigest()[:13] for k in mine}
        for k in sorted(mine, key=key.get):
            running[s] += len(words(docs[k][1]))
            out[k] = passes + (part > 0 and running[s] <= part)
    return out


# ---------------------------------------------------------------- pieces


def pieces(doc_id, text, encode, length=2048):
    """(doc_id, piece, start, length, ids_crc32) of a document."""
    ids = [*encode(text or ""), 0]
    first = len(ids) % length or length
    cuts = [0, *range(first, len(ids) + 1, length)]
    return [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
