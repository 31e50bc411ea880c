"""Plain versions of the corpus queries, for small tables, and a table with hard cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def hard_rows(seed: int = 1) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """documents, benchmark and labels: nulls, empty and long texts, copies, repeated rows, shared passages, odd spaces."""
    rng = random.Random(seed)
    vocabulary = [f"{w}{k}" for w in ("Alpha", "beta", "ΓΑΜΜΑ", "delta", "ſtraße", "日本", "ε", "x") for k in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages, line = [text(60) for _ in range(4)], text(30)
    docs: list[str | None] = [None, "", " \t\n\x0b\x0c\r", "one", "one two", "One  TWO", "a\x1fb c  d", "x " * 300, "x " * 301, "# $ % & | < > * [\n\n a \n a\n"]
    docs += [text(rng.randint(1, 120)) for _ in range(40)]
    docs += [text(20) + " " + p + "\n" + text(20) for p in passages for _ in range(3)]
    docs += [line + "\n" + text(15) + "\n" + line for _ in range(12)]
    copy = text(400)
    docs += [copy] * 6 + [copy + " tail", copy.replace("beta", "Beta"), copy.upper(), long := text(9000), long + " tail", passages[0] * 3]
    base = text(1500).split(" ")
    docs += [" ".join("changed" if i % 40 < k and i < 60 * k else w for i, w in enumerate(base)) for k in range(12)]  # near copies
    items = [(1, passages[1]), (2, passages[1]), (3, "one two"), (4, None), (5, ""), (6, text(12)), (70, "".join(c.upper() if c.isascii() else c for c in line)), (8, "!!!")]
    rows = [(3 * k + 1, t, rng.choice(["en", None]), rng.choice(["hot", "hot", "hot", "b.org", None]), None) for k, t in enumerate(docs)]
    rows += [rows[12], rows[0], rows[60]]  # repeated rows
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in rows if rng.random() < 0.7]
    return rows, items, labels


def write(path, docs: list[tuple], items: list[tuple], labels: list[tuple], pages: list[tuple] = ()) -> str:
    """Tables with further columns whose names clash with those of the operators."""
    extra = {c: pa.array([None] * len(docs), pa.string()) for c in ("spans", "part", "score", "fp", "shard", "_w", "cell", "component_id", "n_words", "sequence_id", "digest", "rep", "size", "base_failed", "held_out")}
    cols = list(zip(*docs, strict=True)) or [[]] * 5
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
    pq.write_table(pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "text", "lang", "source", "n_chars"), cols, types, strict=True)} | extra), f"{path}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string()), "doc_id": pa.array([0] * len(items), pa.int64())}), f"{path}/benchmark.parquet")
    pq.write_table(pa.table({n: pa.array([r[k] for r in labels], pa.int64()) for k, n in enumerate(("doc_id", "quality", "toxic"))} | {"text": pa.array(["?"] * len(labels), pa.string())}), f"{path}/labels.parquet")
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages], pa.string()), "html": pa.array([p[2] for p in pages], pa.string()), "hash": pa.array([None] * len(pages), pa.string())}), f"{path}/pages.parquet")
    return str(path)


def blocks(docs: list[tuple], n: int = 13) -> list[tuple]:
    words = [(d, WORD.findall(t or "")) for d, t, *_ in docs]
    least: dict[tuple, int] = {}
    for d, w in words:
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            least[g] = min(least.get(g, d), d)
    out = []
    for d, w in words:
        gone = {i + k for i in range(len(w) - n + 1) if least[tuple(w[i : i + n])] < d for k in range(n)}
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return out


def leaks(docs: list[tuple], items: list[tuple], n: int = 10) -> list[tuple]:
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = ITEM.findall((t or "").translate(UPPER))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(g) for g in windows}
    out = []
    for d, t, *_ in docs:
        w = ITEM.findall((t or "").translate(UPPER))
        hit, ids = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (g := tuple(w[i : i + m])) in windows:
                    hit |= set(range(i, i + m))
                    ids |= windows[g]
        out.append((d, len(w), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), bool(hit)))
    return out


def rules(docs: list[tuple]) -> list[tuple]:
    """The base of the quality rules."""
    out = []
    for d, t, *_ in docs:
        t = t or ""
        w = WORD.findall(t)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = {i + k for i, g in enumerate(tri) if tri.count(g) > 1 for k in range(3)} if len(tri) < 3000 else None
        if many is None:
            n = Counter(tri)
            many = {i + k for i, g in enumerate(tri) if n[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(many), len(w) < 50 or 100 * len(many) > 50 * len(w)))
    return out


def simhash(docs: list[tuple]) -> list[tuple]:
    fps = []
    for _, t, *_ in docs:
        w = WORD.findall((t or "").translate(UPPER))
        g = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(docs)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, r in enumerate(docs):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], f"{fps[i]:016x}", least[find(i)]) for i, r in enumerate(docs)]


def repeated_bytes(docs: list[tuple], width: int = 200) -> list[tuple]:
    """(doc_id, bytes, a 1 for each byte under a repeated string)."""
    data = [(r[0], (r[1] or "").encode()) for r in docs]
    seen: dict[bytes, int] = {}
    for _, b in data:
        for i in range(len(b) - width + 1):
            seen[b[i : i + width]] = seen.get(b[i : i + width], 0) + 1
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        out.append((d, b, gone))
    return out


def suffixes(docs: list[tuple], width: int = 200) -> list[tuple]:
    out = []
    for d, b, gone in repeated_bytes(docs, width):
        runs = len(re.findall(b"\1+", bytes(gone)))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), runs, sha(left)))
    return out


def without_repeats(docs: list[tuple]) -> list[tuple]:
    """(doc_id, text) with the characters that lie wholly under repeats cut; documents that are emptied go."""
    out = []
    for (d, b, gone), (_, text, *_) in zip(repeated_bytes(docs), docs, strict=True):
        left, at = [], 0
        for c in b.decode():
            n = len(c.encode())
            if not all(gone[at : at + n]):
                left.append(c)
            at += n
        if left or not any(gone):
            out.append((d, "".join(left) if any(gone) else text))
    return out


def crc(x: object) -> int:
    return zlib.crc32(str(x).encode())


def divergences(docs: list[tuple], least: int = 3, top: int = 200) -> list[tuple]:
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))) for _, text, lang, source, *_ in docs]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        found = Counter(t for *_, w in own for t in set(w))
        kept = [t for t, n in found.items() if n >= least]
        counts = {s: Counter(t for _, x, w in own if x == s for t in w) for s in {r[1] for r in own}}
        counts[None] = sum(counts.values(), Counter())
        total = {s: sum(c[t] for t in kept) + len(kept) for s, c in counts.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // total[s] for t in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in set(counts) - {None}:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in set(counts) - {None, s})
            terms = sorted((-f(p[s][t], p[None][t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > p[None][t])
            for part, found_rows in (("pair", pairs), ("term", terms[:top])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found_rows)]
    return out


def near(docs: list[tuple], width: int = 4) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept); a null id is no least one."""
    sets = []
    for _, t, *_ in docs:
        w = WORD.findall((t or "").translate(UPPER))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(docs)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, r in enumerate(docs):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), c := least.get(find(i)), r[0] is not None and r[0] == c) for i, r in enumerate(docs)]


def manifest(docs: list[tuple]) -> list[tuple]:
    h = lambda *parts: sha("".join(parts).encode())
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: h(*map(part, (r[0], r[3], r[2], r[4], t)))

    def climb(leaves: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
        paths, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
        while len(level) > 1:
            runs = [level[k : k + 8] for k in range(0, len(level), 8)]
            for p, k in zip(paths, at, strict=True):
                p.append((k % 8, runs[k // 8]))
            level, at = [h(*r) for r in runs], [k // 8 for k in at]
        return level[0], paths

    groups: dict[tuple, list] = {}
    for r in docs:
        t = r[1].translate(UPPER) if r[1] is not None and r[0] is not None and crc(r[0]) % 3 == 0 else r[1]
        groups.setdefault((r[2] is not None, (r[2] or "").encode()), []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, t)))
    trees = [(sorted(g), *climb([x[2] for x in sorted(g)])) for _, g in sorted(groups.items())]
    root, tops = climb([t[1] for t in trees])
    out = []
    for (rows, sub, paths), top in zip(trees, tops, strict=True):
        for (known, d, was, now), path in zip(rows, paths, strict=True):
            proof = ""
            for k, run in path + top:
                proof += "".join(run[:k] + run[k + 1 :])
                now = h(*run[:k], now, *run[k + 1 :])
            out.append((d if known else None, was, sub, root, sha(proof.encode()), now, now == root))
    return out
