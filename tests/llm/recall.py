"""Measured recall of the near-duplicate candidates: ``python -m tests.llm.recall FOLDER [K PERCENT]``.

Of all pairs of different shingle sets at or above the threshold, found exactly
by prefixes of their rarest shingles, the share that has a band in common.
"""

import sys
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq

from quire.llm import byteops, minhash


def pairs_above(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """All pairs of sets with 100 * intersection >= percent * union."""
    every, counts = np.unique(np.concatenate(sets), return_counts=True)
    groups, found, seen = defaultdict(list), [], set()
    for i, s in enumerate(sets):
        rare = s[np.argsort(counts[np.searchsorted(every, s)], kind="stable")]
        # A pair at the threshold differs in fewer shingles than the prefix has.
        for h in rare[: len(s) - -(-len(s) * percent // 100) + 1].tolist():
            groups[h].append(i)
    for members in groups.values():
        for a, b in combinations(members, 2):
            if (a, b) not in seen:
                seen.add((a, b))
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    found.append((a, b))
    return found


def measure(texts, k: int = 3, percent: int = 85) -> tuple[int, int]:
    """Pairs at or above the threshold, and how many of them share a band."""
    sets, keys, known = [], [], set()
    for _, _, buf, off in byteops.slices(texts):
        h, bounds = minhash.shingle_sets(buf, off, k)
        bands = minhash.band_keys(minhash.signatures(h, bounds))
        for i in range(len(off) - 1):
            own = h[bounds[i] : bounds[i + 1]]
            if len(own) and own.tobytes() not in known:
                known.add(own.tobytes())
                sets.append(own)
                keys.append(bands[i])
    pairs = pairs_above(sets, percent)
    return len(pairs), sum(bool((keys[a] == keys[b]).any()) for a, b in pairs)


if __name__ == "__main__":
    above, shared = measure(pq.read_table(f"{sys.argv[1]}/documents.parquet", columns=["text"]).column("text").combine_chunks(), *map(int, sys.argv[2:]))
    print(f"pairs {above}, with a band in common {shared}")
