"""Documents packed into containers of fixed capacity.

Method, best-two-fit: a container is filled greedily with the largest unpacked document that
fits; then its smallest document gives way to two unpacked ones that fill the widened gap more
tightly, as long as such two exist. Documents are dealt by a hash of their id into buckets of a
bounded size that are packed independently, each in one task; only ids and sizes are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; sizes are 0 to capacity. Items of size 0 go into container 0."""
    place = np.zeros(len(sizes), dtype=np.int64)
    stock: dict[int, list[int]] = {}
    for i in np.argsort(sizes, kind="stable"):
        stock.setdefault(int(sizes[i]), []).append(int(i))
    stock.pop(0, None)
    mask = sum(1 << s for s in stock)

    def take(s: int) -> int:
        nonlocal mask
        i = stock[s].pop()
        if not stock[s]:
            mask ^= 1 << s
        return i

    def largest(room: int) -> int:
        return (mask & ((1 << (room + 1)) - 1)).bit_length() - 1

    def two(room: int, over: int) -> tuple[int, int] | None:
        """Two sizes in stock with over < a + b <= room, the sum as large as can be."""
        best, pair = over, None
        a = largest(room - 1)
        while a > 0 and 2 * a > best:
            b = largest(min(a, room - a))
            if b == a and len(stock[a]) < 2:
                b = largest(min(a - 1, room - a))
            if b > 0 and a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            a = largest(a - 1)
        return pair

    box = 0
    while mask:
        gap, inside = capacity, []
        while gap > 0 and (s := largest(gap)) > 0:
            inside.append((s, take(s)))
            gap -= s
        while gap > 0 and mask:
            s, i = least = min(inside)
            pair = two(gap + s, s)
            if not pair:
                break
            inside.remove(least)
            inside += [(x, take(x)) for x in pair]
            gap += s - sum(pair)
            stock[s].append(i)
            mask |= 1 << s
        place[[i for _, i in inside]] = box
        box += 1
    return place


def packed(sizes: DataFrame, key: str, size: str, *, capacity: int = 2048, bucket_docs: int = 8192) -> DataFrame:
    """(key, part, n_tokens, container_id): the container of each document.

    A document over the capacity is cut: each full capacity is a container of its own, the rest
    (if any) is packed like a document; ``part`` counts its pieces from 0. Others have one row with
    part 0. A document of size 0 or null takes no room and lies in its bucket's first container. A
    repeated key is packed once for each row. Keys should be unique, as they decide the bucket.
    """
    n = sizes.count()
    buckets = max(1, -(-n // bucket_docs))
    kind = sizes.schema[key].dataType.simpleString()
    rows = sizes.select(F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("b"))

    def pack(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["k"], kind="stable")
        n = t.n.to_numpy()
        full, rest = n // capacity, n % capacity
        has_rest = (rest > 0) | (n == 0)
        tail = np.flatnonzero(has_rest)
        place = best_two_fit(rest[tail], capacity)
        boxes = int(place.max()) + 1 if len(place) else 0
        whole = np.repeat(np.arange(len(n)), full)
        part = np.concatenate([np.arange(f) for f in full[full > 0]]) if len(whole) else np.empty(0, np.int64)
        base = int(t.b.iloc[0]) << 32
        return pd.DataFrame(
            {
                "k": np.concatenate([t.k.to_numpy()[tail], t.k.to_numpy()[whole]]),
                "part": np.concatenate([full[tail], part]).astype(np.int32),
                "n": np.concatenate([rest[tail], np.full(len(whole), capacity)]),
                "container_id": np.concatenate([place, boxes + np.arange(len(whole))]) + base,
            }
        )

    out = rows.groupBy("b").applyInPandas(pack, f"k {kind}, part int, n long, container_id long")
    return out.select(F.col("k").alias(key), "part", F.col("n").alias("n_tokens"), "container_id")
