"""Plain Python versions of the contracts, for comparison."""

import glob
import os
import re
from collections import defaultdict

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"


def table(name, sf=SF):
    path = f"{sf}/{name}.parquet"
    files = sorted(glob.glob(path + "/*.parquet")) if os.path.isdir(path) else [path]
    return [row for f in files for row in pq.read_table(f).to_pylist()]


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0d]+", lowered)


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(texts, ids):
    """{row: smallest id reachable} by comparing all pairs."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    groups = defaultdict(list)
    for k in range(len(sets)):
        groups[top(k)].append(ids[k])
    return [min((i for i in groups[top(k)] if i is not None), default=None) for k in range(len(sets))]
