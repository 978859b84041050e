"""Placement of rows on shards by a permutation-filled lookup table (consistent hashing).

Every shard owns a permutation of the slots of a prime-sized table, given by an offset and a skip that
hash from its name. Shards take turns; at each turn a shard claims its next preferred free slot until the
table is full. A row's key hashes to a slot and the slot names the shard: placement is one array read,
the load differs by at most one slot between shards, and adding or removing a shard moves few slots.

The table's size is a parameter, not a function of the data, so it travels inside the plan as one binary
literal of two bytes a slot (128 KiB for the default): nothing is shuffled and no join is planned.

Defined results: a null key hashes like the empty string; repeated rows get the same shard; an empty
table gives an empty result; other columns of the input are left as they are, and a result column whose name the
input has already (in any case) gets as many underscores behind it as make it new.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's permutation ``(offset + i * skip) mod slots``."""
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The lookup table: slot -> index of its shard."""
    if not _is_prime(slots):
        raise ValueError("the number of slots must be prime, or a skip would not visit every slot")
    if not 0 < len(shards) <= min(slots, 65536) or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    # The order of turns must not depend on the order in which the shards were listed.
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    at, skip = zip(*(preference(name, slots) for name in shards), strict=True)
    at, owner, free = list(at), [-1] * slots, slots
    while free:
        for i in order:
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS, *, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard index of each row."""
    packed = b"".join(owner.to_bytes(2, "big") for owner in fill(shards, slots))
    slot = slot_of(F.col(f"`{key}`"), slots)
    cell = F.substr(F.lit(bytearray(packed)), F.lit(2) * slot + 1, F.lit(2))
    taken = {c.lower() for c in df.columns}

    def fresh(name: str) -> str:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        return name

    shard = F.conv(F.hex(cell), 16, 10).cast("int")
    return df.select(*[F.col(f"`{c}`") for c in df.columns], slot.alias(fresh(slot_col)), shard.alias(fresh(shard_col)))
