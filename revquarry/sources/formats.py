"""Decoders of a repository's binary files: bytes in, rows out. They run inside Spark tasks, one file each."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np

from ..operators.delta import apply_delta, make_delta, offset_number, read_offset

# Fixed values of the formats.
PACK_TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFS_DELTA, REF_DELTA = 6, 7
KINDS = {0o100644: "blob", 0o100755: "executable", 0o120000: "symlink", 0o40000: "tree", 0o160000: "gitlink"}
INDEX_TYPES = {8: "regular", 10: "symlink", 14: "gitlink"}
NO_PARENT, EXTRA_PARENTS = 0x70000000, 0x80000000
#: A commit's row in a commit graph; ``high`` has the generation and the time's highest two bits.
GRAPH_ROW = np.dtype([("tree", "V20"), ("first", ">u4"), ("second", ">u4"), ("high", ">u4"), ("low", ">u4")])
#: Commit times and generations that a commit graph can hold stay below these.
GRAPH_TIMES, GRAPH_GENERATIONS = 1 << 34, 1 << 30


def oid_of(kind: str, data: bytes) -> str:
    return hashlib.sha1(f"{kind} {len(data)}\0".encode() + data).hexdigest()


def loose_object(raw: bytes) -> tuple[str, bytes]:
    """Kind and content of a loose object's file."""
    whole = zlib.decompress(raw)
    head, _, data = whole.partition(b"\0")
    kind, _, size = head.partition(b" ")
    if not 0 < len(kind) <= 10 or not 0 < len(size) <= 64 or int(size) != len(data):
        raise ValueError("invalid loose object")
    return kind.decode(), data


def tree(data: bytes) -> list[dict]:
    """A tree's entries in stored order; names that aren't UTF-8 are decoded with replacement."""
    out, at = [], 0
    while at < len(data):
        space = data.index(b" ", at)
        end = data.index(b"\0", space)
        mode = data[at:space].decode()
        out.append({"ordinal": len(out), "mode": mode, "kind": KINDS.get(int(mode, 8)), "name": data[space + 1 : end].decode("utf-8", "replace"), "oid": data[end + 1 : end + 21].hex()})
        at = end + 21
    return out


def _inflated(raw: bytes, at: int) -> tuple[bytes, int]:
    """A compressed stream that begins at ``at``, and where it ends; fed in growing slices, as its length isn't known."""
    inflate, parts, step, view = zlib.decompressobj(), [], 512, memoryview(raw)
    while not inflate.eof:
        if at >= len(raw):
            raise ValueError("a compressed stream is cut off")
        parts.append(inflate.decompress(view[at : at + step]))
        at, step = min(at + step, len(raw)), min(2 * step, 1 << 20)
    return b"".join(parts), at - len(inflate.unused_data)


def pack(raw: bytes) -> Iterator[dict]:
    """Every object of a pack: ``offset, kind, data``, or ``base_oid, delta`` where the base is in no pack entry here.

    Chains of deltas inside the pack are resolved; each base is made once.
    """
    signature, version, count = struct.unpack(">4sII", raw[:12])
    if signature != b"PACK" or version != 2:
        raise ValueError("not a pack of version 2")
    entries: dict[int, tuple] = {}
    at = 12
    for _ in range(count):
        start, b = at, raw[at]
        kind, at = b >> 4 & 7, at + 1
        while b & 128:
            b = raw[at]
            at += 1
        base: int | str | None = None
        if kind == OFS_DELTA:
            back, at = read_offset(raw, at)
            base = start - back
        elif kind == REF_DELTA:
            base, at = raw[at : at + 20].hex(), at + 20
        data, at = _inflated(raw, at)
        entries[start] = (kind, base, data)
    made: dict[int, tuple[str, bytes]] = {}
    by_oid: dict[str, int] = {}

    def resolve(start: int) -> tuple[str, bytes] | None:
        chain = []
        while start not in made:
            kind, base, data = entries[start]
            if kind in PACK_TYPES:
                made[start] = PACK_TYPES[kind], data
                break
            below = base if kind == OFS_DELTA else by_oid.get(base)
            if below is None:
                return None
            chain.append((start, data))
            start = below
        for above, delta in reversed(chain):
            kind, data = made[start]
            made[above] = kind, apply_delta(data, delta)
            start = above
        return made[start]

    waiting = list(entries)
    while waiting:
        left = []
        for start in waiting:
            found = resolve(start)
            if found is None:
                left.append(start)
            else:
                by_oid[oid_of(*found)] = start
        if len(left) == len(waiting):
            break
        waiting = left
    for start, (kind, base, data) in entries.items():
        if start in made:
            yield {"offset": start, "kind": made[start][0], "data": made[start][1], "base_oid": None, "delta": None}
        else:
            while kind == OFS_DELTA and entries[base][0] == OFS_DELTA:
                _, base, below = entries[base]
            yield {"offset": start, "kind": None, "data": None, "base_oid": base if kind == REF_DELTA else None, "delta": data}


def pack_index(raw: bytes) -> Iterator[dict]:
    """``oid, offset, crc`` of every object that a pack's index (version 2) lists, in its order."""
    if raw[:8] != b"\xfftOc\0\0\0\x02":
        raise ValueError("only pack indexes of version 2 are read")
    n = struct.unpack(">I", raw[8 + 255 * 4 : 8 + 256 * 4])[0]
    ids = 8 + 256 * 4
    crcs, small = ids + 20 * n, ids + 24 * n
    large = small + 4 * n
    for i in range(n):
        (offset,) = struct.unpack_from(">I", raw, small + 4 * i)
        if offset & 0x80000000:
            (offset,) = struct.unpack_from(">Q", raw, large + 8 * (offset & 0x7FFFFFFF))
        yield {"oid": raw[ids + 20 * i : ids + 20 * i + 20].hex(), "offset": offset, "crc": struct.unpack_from(">I", raw, crcs + 4 * i)[0]}


def _chunks(raw: bytes, count: int, at: int) -> dict[bytes, tuple[int, int]]:
    rows = [struct.unpack_from(">4sQ", raw, at + 12 * i) for i in range(count + 1)]
    return {name: (start, after) for (name, start), (_, after) in zip(rows, rows[1:], strict=False)}


def multi_pack_index(raw: bytes) -> Iterator[dict]:
    """``pack, oid, offset`` of every object of a multi-pack index."""
    signature, version, hashes, chunks, _, _ = struct.unpack(">4sBBBBI", raw[:12])
    if signature != b"MIDX" or version != 1 or hashes != 1:
        raise ValueError("not a multi-pack index")
    at = _chunks(raw, chunks, 12)
    names = [x.decode() for x in raw[slice(*at[b"PNAM"])].split(b"\0") if x]
    (n,) = struct.unpack_from(">I", raw, at[b"OIDF"][0] + 255 * 4)
    for i in range(n):
        pack_no, offset = struct.unpack_from(">II", raw, at[b"OOFF"][0] + 8 * i)
        if offset & 0x80000000 and b"LOFF" in at:
            (offset,) = struct.unpack_from(">Q", raw, at[b"LOFF"][0] + 8 * (offset & 0x7FFFFFFF))
        start = at[b"OIDL"][0] + 20 * i
        yield {"pack": names[pack_no].rsplit(".", 1)[0], "oid": raw[start : start + 20].hex(), "offset": offset}


def graph_chunks(raw: bytes) -> dict[bytes, tuple[int, int]]:
    """Where a commit graph's chunks start and end, from its first bytes."""
    signature, version, hashes, chunks, _ = struct.unpack(">4sBBBB", raw[:8])
    if signature != b"CGPH" or version != 1 or hashes != 1:
        raise ValueError("not a commit graph")
    return _chunks(raw, chunks, 8)


def graph_head(counts: list[int], edges: int) -> bytes:
    """A commit graph up to its commits' ids, from the number of commits for each first byte and that of extra edges."""
    n = sum(counts)
    chunks = [(b"OIDF", 1024), (b"OIDL", 20 * n), (b"CDAT", 36 * n), *([(b"EDGE", 4 * edges)] if edges else [])]
    out, at = bytearray(struct.pack(">4sBBBB", b"CGPH", 1, 1, len(chunks), 0)), 8 + 12 * (len(chunks) + 1)
    for name, size in [*chunks, (b"\0\0\0\0", 0)]:
        out += struct.pack(">4sQ", name, at)
        at += size
    return bytes(out) + np.cumsum(counts).astype(">u4").tobytes()


def commit_graph(raw: bytes, earlier: list[str] | None = None) -> list[dict]:
    """``oid, tree, parents, commit_time, generation`` of a graph file; ``earlier`` are the ids of the chain's files below it, in order."""
    at = graph_chunks(raw)
    (n,) = struct.unpack_from(">I", raw, at[b"OIDF"][0] + 255 * 4)
    ids = [raw[at[b"OIDL"][0] + 20 * i : at[b"OIDL"][0] + 20 * i + 20].hex() for i in range(n)]
    known = [*(earlier or []), *ids]
    out = []
    for i, oid in enumerate(ids):
        start = at[b"CDAT"][0] + 36 * i
        first, second, high, low = struct.unpack_from(">IIII", raw, start + 20)
        parents = [first] if first != NO_PARENT else []
        if second & EXTRA_PARENTS:
            edge = at[b"EDGE"][0] + 4 * (second & 0x7FFFFFFF)
            while True:
                (p,) = struct.unpack_from(">I", raw, edge)
                parents.append(p & 0x7FFFFFFF)
                edge += 4
                if p & EXTRA_PARENTS:
                    break
        elif second != NO_PARENT:
            parents.append(second)
        out.append({"oid": oid, "tree": raw[start : start + 20].hex(), "parents": [known[p] for p in parents], "commit_time": (high & 3) << 32 | low, "generation": high >> 2})
    return out


def staging_index(raw: bytes) -> Iterator[dict]:
    """Every entry of a staging index of version 2, 3 or 4, in order, with its stage."""
    signature, version, n = struct.unpack(">4sII", raw[:12])
    if signature != b"DIRC" or version not in (2, 3, 4):
        raise ValueError("not a staging index of version 2 to 4")
    at, path = 12, b""
    for ordinal in range(n):
        start = at
        cs, cn, ms, mn, _, _, mode, _, _, size = struct.unpack_from(">10I", raw, at)
        oid = raw[at + 40 : at + 60].hex()
        (flags,) = struct.unpack_from(">H", raw, at + 60)
        at += 62 + 2 * (flags >> 14 & 1 and version > 2)
        if version == 4:
            drop, at = read_offset(raw, at)
            end = raw.index(b"\0", at)
            path = path[: len(path) - drop] + raw[at:end]
            at = end + 1
        else:
            end = raw.index(b"\0", at)
            path = raw[at:end]
            at = start + (end - start + 8) // 8 * 8
        yield {"ordinal": ordinal, "path": path.decode("utf-8", "replace"), "oid": oid, "type": INDEX_TYPES.get(mode >> 12), "perms": mode & 0o777, "size": size, "ctime": cs, "ctime_nanos": cn, "mtime": ms, "mtime_nanos": mn, "stage": flags >> 12 & 3}


def write_staging(entries: list[tuple[str, int, str, int, int]]) -> bytes:
    """A staging index of version 2 from (path, mode, oid, size, time), in path order."""
    out = bytearray(struct.pack(">4sII", b"DIRC", 2, len(entries)))
    for path, mode, oid, size, at in sorted(entries, key=lambda e: e[0].encode()):
        name = path.encode()
        entry = struct.pack(">10I", at, 0, at, 0, 0, 0, mode, 0, 0, size & 0xFFFFFFFF) + bytes.fromhex(oid) + struct.pack(">H", min(len(name), 0xFFF)) + name
        out += entry + bytes(8 - len(entry) % 8)
    return bytes(out) + hashlib.sha1(out).digest()


def write_commit_graph(commits: list[dict]) -> bytes:
    """A commit graph from ``oid, tree, parents, commit_time``; generations count from 1 at the roots."""
    rows = sorted(commits, key=lambda c: c["oid"])
    place = {c["oid"]: i for i, c in enumerate(rows)}
    generation: dict[str, int] = {}
    for c in rows:
        waiting = [c["oid"]]
        while waiting:
            above = rows[place[waiting[-1]]]["parents"]
            missing = [p for p in above if p not in generation]
            if missing:
                waiting += missing
            else:
                generation[waiting.pop()] = 1 + max((generation[p] for p in above), default=0)
    data, edges, counts = bytearray(), bytearray(), [0] * 256
    for c in rows:
        counts[int(c["oid"][:2], 16)] += 1
        above = [place[p] for p in c["parents"]]
        second = above[1] if len(above) == 2 else NO_PARENT
        if len(above) > 2:
            second = EXTRA_PARENTS | len(edges) // 4
            edges += b"".join(struct.pack(">I", p) for p in above[1:-1]) + struct.pack(">I", above[-1] | EXTRA_PARENTS)
        data += bytes.fromhex(c["tree"]) + struct.pack(">IIII", above[0] if above else NO_PARENT, second, generation[c["oid"]] << 2 | c["commit_time"] >> 32, c["commit_time"] & 0xFFFFFFFF)
    out = graph_head(counts, len(edges) // 4) + b"".join(bytes.fromhex(c["oid"]) for c in rows) + data + edges
    return bytes(out) + hashlib.sha1(out).digest()


def write_loose(kind: str, data: bytes) -> bytes:
    return zlib.compress(f"{kind} {len(data)}\0".encode() + data)


#: How packs are made: bases tried for an object, longest chain, bytes that a delta must save.
PACK_WINDOW, PACK_DEPTH, PACK_SAVES = 10, 10, 50


def chain_depth(wanted: int) -> int:
    """The longest chain of deltas that is allowed, between 1 and 50."""
    return min(50, max(1, wanted))


def _plan(objects: list[tuple[str, bytes]], depth: int) -> list[tuple[int, int | None, bytes]]:
    """(object, base's place in this list or None, bytes to store): by kind and falling size, deltas against those just before."""
    order = sorted(range(len(objects)), key=lambda i: (objects[i][0], -len(objects[i][1])))
    plan: list[tuple[int, int | None, bytes]] = []
    depths: list[int] = []
    for i in order:
        kind, data = objects[i]
        best: tuple[int | None, bytes] = (None, data)
        for k in range(len(plan) - 1, max(-1, len(plan) - 1 - PACK_WINDOW), -1):
            other, base = objects[plan[k][0]]
            if other != kind or depths[k] >= depth or not data or 2 * len(data) < len(base):
                continue
            made = make_delta(base, data)
            if len(made) + PACK_SAVES <= len(best[1]):
                best = (k, made)
        depths.append(0 if best[0] is None else depths[best[0]] + 1)
        plan.append((i, *best))
    return plan


def write_pack(objects: list[tuple[str, bytes]], deltas: bool = False, depth: int = PACK_DEPTH) -> tuple[bytes, bytes]:
    """A pack (version 2) and its index (version 2). With ``deltas`` objects may refer to bases in the same pack."""
    codes = {v: k for k, v in PACK_TYPES.items()}
    body = bytearray(struct.pack(">4sII", b"PACK", 2, len(objects)))
    plan = _plan(objects, chain_depth(depth)) if deltas else [(i, None, data) for i, (_, data) in enumerate(objects)]
    listed, starts = [], []
    for i, base, stored in plan:
        kind, data = objects[i]
        start, n = len(body), len(stored)
        head = bytearray([(codes[kind] if base is None else OFS_DELTA) << 4 | n & 15])
        n >>= 4
        while n:
            head[-1] |= 128
            head.append(n & 127)
            n >>= 7
        if base is not None:
            head += offset_number(start - starts[base])
        entry = bytes(head) + zlib.compress(stored)
        listed.append((bytes.fromhex(oid_of(kind, data)), zlib.crc32(entry), start))
        starts.append(start)
        body += entry
    trailer = hashlib.sha1(body).digest()
    listed.sort()
    fanout, large = [0] * 256, []
    for oid, _, _ in listed:
        fanout[oid[0]] += 1
    total, out = 0, bytearray(b"\xfftOc" + struct.pack(">I", 2))
    for k in fanout:
        total += k
        out += struct.pack(">I", total)
    out += b"".join(oid for oid, _, _ in listed)
    out += b"".join(struct.pack(">I", crc) for _, crc, _ in listed)
    for _, _, offset in listed:
        if offset >= 1 << 31:
            large.append(offset)
            offset = 0x80000000 | len(large) - 1
        out += struct.pack(">I", offset)
    out += b"".join(struct.pack(">Q", x) for x in large) + trailer
    return bytes(body) + trailer, bytes(out) + hashlib.sha1(out).digest()
