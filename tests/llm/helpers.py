"""Small tables and brute-force models that the operator tests share."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import xxhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return WORD.findall(text or "")


def brute_substring(rows, t=50):
    """rows: (doc_id, text); returns {index: (n_words, n_removed, sha)}."""
    first = {}
    split = [words(x) for _, x in rows]
    for (d, _), w in zip(rows, split):
        for i in range(len(w) - t + 1):
            key = tuple(w[i : i + t])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, split):
        keep = [True] * len(w)
        for i in range(len(w) - t + 1):
            if first[tuple(w[i : i + t])] < d:
                keep[i : i + t] = [False] * t
        kept = " ".join(x for x, k in zip(w, keep) if k)
        out.append((d, len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_suffix(rows, t=200):
    seen = Counter()
    raw = [(d, (x or "").encode()) for d, x in rows]
    for _, b in raw:
        for i in range(len(b) - t + 1):
            seen[b[i : i + t]] += 1
    out = []
    for d, b in raw:
        cover = [0] * (len(b) + 1)
        for i in range(len(b) - t + 1):
            if seen[b[i : i + t]] > 1:
                cover[i] += 1
                cover[i + t] -= 1
        run, keep = 0, []
        for c in cover[:-1]:
            run += c
            keep.append(run == 0)
        spans = sum(not k and (i == 0 or keep[i - 1]) for i, k in enumerate(keep))
        kept = bytes(x for x, k in zip(b, keep) if k)
        out.append((d, len(b), keep.count(False), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_simhash(rows, n=3):
    fps = []
    for d, text in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append((d, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))))
    return fps


def brute_components(fps, radius=2):
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _) in enumerate(fps):
        groups.setdefault(find(i), []).append(d)
    return {i: min(groups[find(i)]) for i in range(len(fps))}


def near_brute(rows, similarity=0.8, n=5):
    """Sorted groups of doc_ids joined by pairs of similar shingle sets."""
    sets = []
    for _, text in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] == group[j] or min(len(sets[i]), len(sets[j])) < similarity * max(len(sets[i]), len(sets[j])):
                continue
            common = len(sets[i] & sets[j])
            if common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                group = [group[j] if g == group[i] else g for g in group]
    return sorted(sorted(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group))


def plain_words(text):
    """Lower case, ASCII punctuation and control characters as gaps."""
    return "".join(" " if ord(c) < 128 and not c.isalnum() else c for c in (text or "").lower()).split(" ")


def brute_contamination(docs, items, gram=3, threshold=0.4):
    """{(doc_id, item_id): score} by aligning each item with each whole document that holds a seed of it."""
    out = {}
    for d, text in docs:
        b = [w for w in plain_words(text) if w]
        for item_id, item in items:
            a = [w for w in plain_words(item) if w]
            n = min(gram, len(a))
            seeds = {tuple(a[i : i + n]) for i in range(len(a) - n + 1)} if a else set()
            if not any(tuple(b[i : i + n]) in seeds for i in range(len(b) - n + 1)):
                continue
            row, best = [0] * (len(b) + 1), 0
            for x in a:
                new = [0]
                for j, y in enumerate(b):
                    new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
                row, best = new, max(best, max(new))
            if best / (2 * len(a)) >= threshold:
                out[d, item_id] = max(out.get((d, item_id), 0), best / (2 * len(a)))
    return out


def brute_lines(rows, min_docs=3, depth=3, similarity=0.7):
    """(doc_id, n_lines, n_dropped, sha) of (doc_id, text) rows by one pass over all lines."""
    lines = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if line.strip(" \t\r\x0b\x0c"):
                lines.setdefault(line, set()).add(d)
    tokens = {x: ["<*>" if re.search("[0-9]", t) else t for t in re.split(r"[\x20\x09-\x0D]+", x.strip(" \t\r\x0b\x0c"))] for x in lines}
    leaf = {x: (len(t), *t[:depth]) for x, t in tokens.items()}
    seen, places = {}, Counter()
    for x in lines:
        seen.setdefault(leaf[x], set()).update(lines[x])
        for p, t in enumerate(tokens[x]):
            places[leaf[x], p, t] += len(lines[x])
    templates = {}
    for x in lines:
        if len(seen[leaf[x]]) < min_docs:
            continue
        parts = tuple(t if p < depth or places[leaf[x], p, t] >= min_docs else "<*>" for p, t in enumerate(tokens[x]))
        name = (leaf[x], parts) if sum(t != "<*>" for t in parts) >= similarity * len(parts) else x
        templates.setdefault(name, set()).add(x)
    dropped = {x for xs in templates.values() if len(set().union(*(lines[x] for x in xs))) >= min_docs for x in xs}
    out = []
    for d, text in rows:
        all_ = [] if text is None else text.split("\n")
        kept = [x for x in all_ if x not in dropped]
        out.append((d, len(all_), len(all_) - len(kept), None if text is None else hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def brute_score(weights, bias, text):
    """The toxicity score of given weights: the mean over words of the mean over their grams."""
    m64 = 2**64 - 1

    def place(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & m64
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & m64
        return (h ^ h >> 31) >> 47

    def hashed(chars, start):
        return (start + sum(ord(c) * pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k, c in enumerate(chars))) & m64

    means = []
    for word in (text or "").lower().split():
        p = f"<{word}>"
        at = [place(hashed(p[i : i + n], n)) for n in (3, 4, 5) for i in range(len(p) - n + 1)] + [place(hashed(p, 0))]
        means.append(sum(weights[a] for a in at) / len(at))
    logit = bias + (sum(means) / len(means) if means else 0)
    return 1 / (1 + math.exp(-max(-500, min(500, logit))))


def png_samples(png):
    """The samples of an 8-bit grey PNG, line filters none, sub and up, sample by sample."""
    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    at, packed = 8, b""
    while at < len(png):
        n, kind = struct.unpack(">I", png[at : at + 4])[0], png[at + 4 : at + 8]
        if kind == b"IHDR":
            width, height = struct.unpack(">II", png[at + 8 : at + 16])
        packed += png[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        assert zlib.crc32(png[at + 4 : at + 8 + n]) == struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]
        at += 12 + n
    raw, lines, above, kinds = zlib.decompress(packed), [], bytes(width), []
    for y in range(height):
        kind, line = raw[y * (width + 1)], bytearray(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        for x in range(width):
            line[x] = (line[x] + {0: 0, 1: line[x - 1] if x else 0, 2: above[x]}[kind]) & 255
        above = bytes(line)
        lines.append(above)
        kinds.append(kind)
    return lines, kinds


def brute_feature(lines, grid=32, low=8):
    """Signs of the lowest cosine coefficients of the samples averaged on a grid, as hex."""

    def spans(n):
        if n < grid:
            return [(i * n // grid, i * n // grid + 1) for i in range(grid)]
        edge = [i * n // grid for i in range(grid)] + [n]
        return list(zip(edge, edge[1:]))

    ys, xs = spans(len(lines)), spans(len(lines[0]))
    small = [[sum(sum(lines[y][a:b]) for y in range(c, d)) / ((b - a) * (d - c)) for a, b in xs] for c, d in ys]
    cos = [[math.cos(math.pi * k * (2 * x + 1) / (2 * grid)) for x in range(grid)] for k in range(low)]
    values = [round(sum(cos[u][y] * sum(cos[v][x] * small[y][x] for x in range(grid)) for y in range(grid)), 6) for u in range(low) for v in range(low)]
    middle = sorted(values[1:])[len(values[1:]) // 2]
    bits = "".join("1" if v > middle else "0" for v in values)
    return f"{int(bits, 2):016x}"
