"""What a vertex does in a superstep of the Merkle manifest (operator 13). These functions run in the workers, which load nothing but this."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql.types import Row

FAN = 16


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def up(n: int) -> int:
    return -(-n // FAN)


def vertex(item: tuple) -> tuple:
    """tree, place, vertices of this level, digest, the children's digests."""
    (tree, place), (n, children) = item
    digests = [d for _, d in sorted(children)]
    return tree, place, up(n), sha("".join(digests)), digests


def rounds(n: int) -> int:
    """How many levels stand above n vertices."""
    rounds = 0
    while n > 1:
        n, rounds = up(n), rounds + 1
    return rounds


def step(children: list[str], slot: int) -> tuple[str, str]:
    return "".join(children[:slot]), "".join(children[slot + 1 :])


def told(item: tuple) -> Iterator[tuple]:
    """A parent with its path tells each child the child's path."""
    (tree, place), (children, (subroot, root, path)) = item
    for slot, _ in enumerate(children):
        yield (tree, place * FAN + slot), (subroot, root, [step(children, slot), *path])


def hearing(r: Row) -> tuple:
    return (r.tree, r.place), (r.subroot, r.root, [tuple(x) for x in r.path])


def run(item: tuple) -> tuple:
    """A run of leaves: tree, place, n, digest, members."""
    (tree, place), (n, members) = item
    members = sorted(members)
    return tree, place, up(n), members[0][2] if n == 1 else sha("".join(m[2] for m in members)), n == 1, members


def checked(item: tuple) -> Iterator[tuple]:
    """Each leaf of a run: what it is, its proof, and the root that it folds up to."""
    _, ((lone, members), (subroot, root, path)) = item
    digests = [m[2] for m in members]
    for slot, (_, doc_id, leaf, seen) in enumerate(members):
        steps = path if lone else [step(digests, slot), *path]
        at = leaf if seen is None else seen
        for left, right in steps:
            at = sha(left + at + right)
        yield doc_id, leaf, subroot, root, sha("".join(a + b for a, b in steps)), at, at == root
