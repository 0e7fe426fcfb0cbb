"""Content ids and the placement hashes of a key over a list of nodes."""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(text: Column) -> Column:
    """SHA-256 of the JSON form of a string."""
    quoted = F.regexp_replace(F.regexp_replace(text, "\\\\", "\\\\\\\\"), '"', '\\\\"')
    return F.sha2(F.concat(F.lit('"'), quoted, F.lit('"')), 256)


def get_id(value: object) -> str:
    return hashlib.sha256(json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def node_id(ip: str, port: int) -> str:
    return get_id({"ip": ip, "port": port})


def short_id(ip: str, port: int) -> str:
    return node_id(ip, port)[:5]


def modulo_node(key_id: str, nodes: list[str]) -> str:
    """The node at the key's number modulo the count, nodes in sorted order."""
    return sorted(nodes)[int(key_id, 16) % len(nodes)]


def ring_node(key_id: str, nodes: list[str]) -> str:
    """Consistent hashing: the first node that follows the key on the ring."""
    ring = sorted(nodes, key=lambda n: int(n, 16))
    at = bisect_left([int(n, 16) for n in ring], int(key_id, 16))
    return ring[at % len(ring)]


def rendezvous_node(key_id: str, nodes: list[str]) -> str:
    """The node whose hash together with the key is largest."""
    return max(nodes, key=lambda n: int(get_id(key_id + n), 16))
