"""Plain versions of the operators, for small inputs: quadratic, on the driver, straight from the contracts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEST_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def lower(x: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def base_quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    where = defaultdict(list)
    for i in range(len(words) - 4):
        where[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def decontaminate(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = TEST_WORD.findall(lower(text or ""))
        for i in range(max(len(w) - 12, 1) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = TEST_WORD.findall(lower(text or ""))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if own := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def without_passages(text, items):
    """A text without its words inside benchmark windows and what stands between neighbouring ones, until no window is left."""
    windows = set()
    for _, t in items:
        w = TEST_WORD.findall(lower(t or ""))
        windows |= {tuple(w[i : i + 13]) for i in range(max(len(w) - 12, 1) if w else 0)}
    while True:
        at = [m.span() for m in TEST_WORD.finditer(lower(text))]
        w = [lower(text)[a:b] for a, b in at]
        hit = {i + k for size in {len(x) for x in windows} for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in windows for k in range(size)}
        if not hit:
            return text
        gone = set()
        for i in hit:
            gone.update(range(at[i][0], at[i + 1][0] if i + 1 in hit else at[i][1]))
        text = "".join(c for k, c in enumerate(text) if k not in gone)


def line_dedup(docs, min_chars=40, min_docs=5):
    key = lambda line: lower(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = defaultdict(set)
    for row, (doc, text) in enumerate(docs):
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add((row, doc))
    keeper = {k: max(d for _, d in h) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or doc == keeper[key(x)]]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def substring_dedup(docs, size=50):
    first = {}
    split = [(doc, WORD.findall(text or "")) for doc, text in docs]
    for doc, w in split:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, w in split:
        gone = {i + k for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < doc for k in range(size)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), sha(" ".join(kept))))
    return out


def simhash(text):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    n = min(3, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(docs, distance=3):
    prints = [(doc, simhash(text)) for doc, text in docs]
    distinct = sorted({p for _, p in prints})
    parent = {p: p for p in distinct}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    least = {}
    for doc, p in prints:
        least[find(p)] = min(least.get(find(p), doc), doc)
    return [(doc, f"{p:016x}", least[find(p)]) for doc, p in prints]


def base_lm(docs):
    tokens = {k: [*WORD.findall(lower(text or "")), None] for k, (_, text) in enumerate(docs)}
    held = {k: zlib.crc32(str("" if doc is None else doc).encode()) % 10 == 0 for k, (doc, _) in enumerate(docs)}
    counts = Counter(t for k, ts in tokens.items() if not held[k] for t in ts)
    n, v = sum(counts.values()), len(counts)
    return [
        (doc, held[k], len(tokens[k]), sum(counts[t] > 0 for t in tokens[k]), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens[k]))
        for k, (doc, _) in enumerate(docs)
    ]


def unigram_lm(docs, pieces, offset, end, rounds):
    """(doc, log10 probability): weights from merge ranks, fitted by forward-backward sums over each training word."""
    weight = {t: 1 / (offset - s) for t, s in zip(pieces.texts, pieces.scores) if s > -1e8}
    byte = min(weight.values())
    scale = (1 - end) / (sum(weight.values()) + 256 * byte)
    weight = {t: w * scale for t, w in weight.items()}
    byte *= scale
    longest = max(map(len, weight))

    def edges(word):
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + longest) + 1):
                if (w := weight.get(word[i:j])) is not None:
                    yield i, j, word[i:j], 1, w
            if word[i] not in weight:
                yield i, i + 1, None, len(word[i].encode()), byte ** len(word[i].encode())

    def forward(word):
        total = [1.0] + [0.0] * len(word)
        for i, j, _, _, w in edges(word):
            total[j] += total[i] * w
        return total

    def backward(word):
        total = [0.0] * len(word) + [1.0]
        for i, j, _, _, w in reversed(list(edges(word))):
            total[i] += total[j] * w
        return total

    split = [(doc, ["\u2581" + w for w in WORD.findall(lower(text or ""))]) for doc, text in docs]
    split = [(doc, [w for w in words if len(w) < 300], [w for w in words if len(w) >= 300]) for doc, words in split]
    held = lambda doc: zlib.crc32(str("" if doc is None else doc).encode()) % 10 == 0
    from decimal import Decimal

    def real(word):  # long words underflow
        total = [Decimal(1)] + [Decimal(0)] * len(word)
        for i, j, _, _, w in edges(word):
            total[j] += total[i] * Decimal(w)
        return total

    for _ in range(rounds):
        sums, ends = Counter(), 0
        for doc, words, long in split:
            if held(doc):
                continue
            ends += 1
            for w in words:
                a, b = forward(w), backward(w)
                for i, j, piece, n, p in edges(w):
                    sums[piece] += n * a[i] * p * b[j] / a[-1]
            for w in long:
                a = real(w)
                b = [Decimal(0)] * len(w) + [Decimal(1)]
                for i, j, _, _, p in reversed(list(edges(w))):
                    b[i] += b[j] * Decimal(p)
                for i, j, piece, n, p in edges(w):
                    sums[piece] += float(n * a[i] * Decimal(p) * b[j] / a[-1])
        whole = sum(sums.values()) + ends + 0.1 * (len(weight) + 2)
        weight = {t: (sums[t] + 0.1) / whole for t in weight}
        byte, end = (sums[None] + 0.1) / 256 / whole, (ends + 0.1) / whole
    return [(doc, math.log10(end) + sum(math.log10(forward(w)[-1]) for w in words) + sum(float(real(w)[-1].log10()) for w in long)) for doc, words, long in split]


def warc(pages):
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    first = {}
    for page, _, html in pages:
        first[digest(html)] = min(first.get(digest(html), page), page)
    out = []
    for page, url, html in pages:
        size = len((html or "").encode())
        again = size >= 100 and first[digest(html)] != page
        out.append((page, url, size, digest(html), "revisit" if again else "response", first[digest(html)] if again else None))
    return out


def chat(turns):
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn, role or "", text or ""))
    out = []
    for conv, rows in by.items():
        rows.sort(key=lambda r: r[0])
        learnt = "".join(t for _, r, t in rows if r == "assistant")
        out.append((conv, len(rows), sha("".join(f"{r}\n{t}\n" for _, r, t in rows)), len(learnt), sha(learnt)))
    return out
