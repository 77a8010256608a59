"""The typed key store: one key holds one value family; commands change or read it.

A command log is a DataFrame (seq, command, key, subkey, value, values, pairs, ttl_seconds, unix_seconds, priority). Its
meaning is a fold of each key's commands in order of seq. `apply_log` runs the folds of different keys in parallel.
Logs of commutative commands alone (INC, ADDSET, ADDHLL and the like) need no order: operators.sets and
operators.sketches aggregate them with map-side combination, which is the way for hot keys.
"""

from __future__ import annotations

import heapq
import math
import time
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import MASK, canonical, fnv1, fnv1a
from .sketches import BloomShape, Cuckoo, Xor

# Other names of commands.
ALIASES = {
    "GETSTR": "GET", "SETSTR": "SET", "SETSTRX": "SETX", "PUSHPRIORITY": "PUSHPQ", "PEEKPRIORITY": "PEEKPQ", "POPPRIORITY": "POPPQ", "GETPRIORITY": "GETPQ",
    "RESERVEBF": "CREATEBF", "BFRESERVE": "CREATEBF", "BFADD": "ADDBF", "BFHAS": "HASBF", "BFEXISTS": "HASBF", "BFINFO": "INFOBF",
    "RESERVECF": "CREATECF", "CFRESERVE": "CREATECF", "CFADD": "ADDCF", "CFHAS": "HASCF", "CFEXISTS": "HASCF", "REMCF": "DELCF", "CFDEL": "DELCF", "CFINFO": "INFOCF",
    "RESERVEXF": "CREATEXF", "XFRESERVE": "CREATEXF", "CREATEXOR": "CREATEXF", "XFADD": "ADDXF", "XFBUILD": "BUILDXF", "XFHAS": "HASXF", "XFEXISTS": "HASXF", "XFINFO": "INFOXF",
    "CREATEROARING": "CREATERB", "RBRESERVE": "CREATERB", "RBADD": "ADDRB", "DELRB": "REMRB", "RBREM": "REMRB", "RBDEL": "REMRB", "RBHAS": "HASRB", "RBEXISTS": "HASRB", "RBCOUNT": "COUNTRB", "RBGET": "GETRB", "RBINFO": "INFORB",
    "CREATESPARSEBITSET": "CREATESB", "SBRESERVE": "CREATESB", "SBADD": "ADDSB", "DELSB": "REMSB", "SBREM": "REMSB", "SBDEL": "REMSB", "SBHAS": "HASSB", "SBEXISTS": "HASSB", "SBCOUNT": "COUNTSB", "SBGET": "GETSB", "SBINFO": "INFOSB",
    "CREATERADIX": "CREATERT", "RTCREATE": "CREATERT", "RTPUT": "PUTRT", "RTGET": "GETRT", "REMRT": "DELRT", "RTDEL": "DELRT", "RTREM": "DELRT", "RTEXISTS": "HASRT", "RTHAS": "HASRT", "SCANRT": "PREFIXRT", "RTPREFIX": "PREFIXRT", "RTSCAN": "PREFIXRT", "RTINFO": "INFORT",
    "RESERVECMS": "CREATECMS", "CMSRESERVE": "CREATECMS", "ADDCMS": "INCRCMS", "CMSADD": "INCRCMS", "QUERYCMS": "ESTCMS", "CMSQUERY": "ESTCMS", "CMSCOUNT": "ESTCMS", "CMSINFO": "INFOCMS",
    "RESERVEHLL": "CREATEHLL", "HLLRESERVE": "CREATEHLL", "HLLADD": "ADDHLL", "ESTHLL": "COUNTHLL", "HLLCOUNT": "COUNTHLL", "HLLCARD": "COUNTHLL", "HLLINFO": "INFOHLL",
    "RESERVETOPK": "CREATETOPK", "TOPKRESERVE": "CREATETOPK", "TOPKADD": "ADDTOPK", "QUERYTOPK": "ESTTOPK", "TOPKCOUNT": "ESTTOPK", "TOPK": "GETTOPK", "TOPKINFO": "INFOTOPK",
    "CREATESAMPLE": "CREATERS", "RESERVERS": "CREATERS", "RSRESERVE": "CREATERS", "RSADD": "ADDRS", "RSGET": "GETRS", "SAMPLE": "GETRS", "RSINFO": "INFORS",
    "CREATEQS": "CREATEQ", "CREATEQUANTILE": "CREATEQ", "RESERVEQ": "CREATEQ", "QSRESERVE": "CREATEQ", "ADDQS": "ADDQ", "QADD": "ADDQ", "QSADD": "ADDQ", "QUERYQ": "ESTQ", "QQUERY": "ESTQ", "QSQUERY": "ESTQ", "QUANTILE": "ESTQ", "QINFO": "INFOQ", "INFOQS": "INFOQ", "QSINFO": "INFOQ",
    "CREATEFENWICK": "CREATEFW", "RESERVEFW": "CREATEFW", "FWRESERVE": "CREATEFW", "FWADD": "ADDFW", "FWGET": "GETFW", "PREFIXFW": "SUMFW", "FWPREFIX": "SUMFW", "FWSUM": "SUMFW", "FWRANGE": "RANGEFW", "FWINFO": "INFOFW",
}
#: Dotted names put the family first: MAP.PUT is PUTMAP.
DOTTED = {"MAP": "MAP", "SLICE": "SLICE", "SET": "SET", "PQ": "PQ", "BF": "BF", "CF": "CF", "XF": "XF", "RB": "RB", "SB": "SB", "RT": "RT", "CMS": "CMS", "HLL": "HLL", "TOPK": "TOPK", "RS": "RS", "Q": "Q", "FW": "FW"}
VERBS = {("CMS", "ADD"): "INCRCMS", ("CMS", "EST"): "ESTCMS", ("HLL", "COUNT"): "COUNTHLL"}
MOST_BATCH = 4096
INT32 = range(-(1 << 31), 1 << 31)
INT64 = range(-(1 << 63), 1 << 63)


def normal(command: str) -> str:
    name = (command or "").strip().upper()
    if "." in name:
        family, verb = name.split(".", 1)
        if family in DOTTED:
            name = VERBS.get((family, verb), verb + DOTTED[family])
    return ALIASES.get(name, name)


class Refused(ValueError):
    pass


def text_of(value) -> str:
    """A value as a response shows it: text as it is, everything else as JSON."""
    return value if isinstance(value, str) else canonical(value).decode()


def whole(text, what: str, within: range | None = None) -> int:
    try:
        n = int(str(text).strip())
    except ValueError:
        raise Refused(what) from None
    if within is not None and n not in within:
        raise Refused(what)
    return n


# ---- the families ----


class Quantiles:
    """Greenwald-Khanna summary: entries (value, gap, delta), sorted."""

    def __init__(self, epsilon: float):
        self.epsilon, self.n, self.entries, self.low, self.high = epsilon, 0, [], math.inf, -math.inf

    def add(self, v: float) -> None:
        at = bisect_left(self.entries, (v,))
        slack = 0 if at in (0, len(self.entries)) else max(0, math.floor(2 * self.epsilon * self.n) - 1)
        self.entries.insert(at, (v, 1, slack))
        self.n += 1
        self.low, self.high = min(self.low, v), max(self.high, v)
        if self.n % max(1, int(1 / (2 * self.epsilon))) == 0:
            self.compress()

    def compress(self) -> None:
        bound, out = math.floor(2 * self.epsilon * self.n), []
        for v, g, d in reversed(self.entries):
            if out and len(out) > 1 and g + out[-1][1] + out[-1][2] <= bound:
                out[-1] = (out[-1][0], out[-1][1] + g, out[-1][2])
            else:
                out.append((v, g, d))
        self.entries = out[::-1]

    def at(self, q: float) -> float:
        if q <= 0:
            return self.low
        if q >= 1:
            return self.high
        rank, room, seen = math.ceil(q * self.n), math.ceil(self.epsilon * self.n), 0
        best = self.entries[0][0]
        for v, g, d in self.entries:
            seen += g
            if seen + d > rank + room:
                return best
            best = v
        return best


class SpaceSaving:
    def __init__(self, capacity: int):
        self.capacity, self.total, self.items = capacity, 0, {}  # canonical -> [value, count, error]

    def add(self, value, count: int) -> list:
        key = canonical(value)
        self.total += count
        if key in self.items:
            self.items[key][1] += count
        elif len(self.items) < self.capacity:
            self.items[key] = [value, count, 0]
        else:
            out = min(self.items, key=lambda k: (self.items[k][1], k))
            least = self.items.pop(out)[1]
            self.items[key] = [value, least + count, least]
        return self.items[key]

    def ranked(self) -> list:
        return [{"value": v, "count": c, "error": e} for _, (v, c, e) in sorted(self.items.items(), key=lambda x: (-x[1][1], x[1][2], x[0]))]


class Store:
    """The live state of some keys; `run` executes one command and gives its response."""

    def __init__(self, clock=time.time):
        self.data: dict[str, tuple[str, object]] = {}
        self.expiry: dict[str, float] = {}
        self.clock = clock

    # access

    def kind(self, key: str) -> str | None:
        if key in self.expiry and self.expiry[key] <= self.clock():
            self.drop(key)
        return self.data[key][0] if key in self.data else None

    def drop(self, key: str) -> bool:
        self.expiry.pop(key, None)
        return self.data.pop(key, None) is not None

    def have(self, key: str, kind: str):
        """The key's value if it is of the kind, else None."""
        return self.data[key][1] if self.kind(key) == kind else None

    def put(self, key: str, kind: str, value) -> object:
        """Another family is replaced, and its expiry goes."""
        if self.kind(key) != kind:
            self.expiry.pop(key, None)
        self.data[key] = (kind, value)
        return value

    def need(self, key: str, kind: str, make) -> object:
        value = self.have(key, kind)
        return self.put(key, kind, make()) if value is None else value

    # running

    def run(self, c: dict) -> dict:
        name = normal(c.get("command"))
        try:
            if not name:
                raise Refused("command is required")
            if name == "BATCH":
                return self.batch(c)
            key = (c.get("key") or "").strip()
            if not key:
                raise Refused("key is required")
            if len(key.encode()) > 32_767:
                raise Refused("key is too long")
            handler = getattr(self, f"do_{name.lower()}", None)
            if handler is None:
                raise Refused("unsupported command")
            message, value = handler(key, c)
            return {"ok": True, "message": message, "value": None if value is None else text_of(value)}
        except Refused as e:
            return {"ok": False, "message": str(e), "value": None}

    def batch(self, c: dict) -> dict:
        """In order, without a transaction; a response for each."""
        items = c.get("batch") or []
        if not items or len(items) > MOST_BATCH:
            raise Refused(f"batch must have 1 to {MOST_BATCH} commands")
        responses = [{"ok": False, "message": "nested batch", "value": None} if normal(x.get("command")) == "BATCH" else self.run(x) for x in items]
        return {"ok": all(r["ok"] for r in responses), "message": "batch executed", "value": None, "responses": responses}

    # arguments

    def values(self, c: dict) -> list:
        """`values` if there are any, else `value`."""
        out = list(c.get("values") or [])
        if not out and c.get("value") not in (None, ""):
            out = [c["value"]]
        if not out:
            raise Refused("value or values is required")
        return out

    def fields(self, c: dict) -> dict:
        out = dict(c.get("pairs") or {})
        if (c.get("subkey") or "").strip():
            out[c["subkey"].strip()] = c.get("value")
        if not out:
            raise Refused("subkey/value or pairs is required")
        return out

    def subkey(self, c: dict) -> str:
        if not (c.get("subkey") or "").strip():
            raise Refused("subkey is required")
        return c["subkey"].strip()

    def found(self, value, message: str = "ok"):
        return ("value not found", None) if value is None else (message, value)

    def expire(self, key: str, c: dict, done: str):
        if c.get("ttl_seconds"):
            self.expiry[key] = self.clock() + float(c["ttl_seconds"])
            return "ttl updated", None
        if c.get("unix_seconds"):
            self.expiry[key] = float(c["unix_seconds"])
            return "ttl updated", None
        return done, None

    def ttl_of(self, c: dict) -> float:
        if not c.get("ttl_seconds") or float(c["ttl_seconds"]) <= 0:
            raise Refused("positive ttl_seconds is required")
        return float(c["ttl_seconds"])

    # operations that have no command

    def append(self, key: str, text: str, front: bool = False) -> str:
        """Text added to a string's end or front; another family is replaced."""
        have = self.have(key, "string") or ""
        return self.put(key, "string", text + have if front else have + text)

    def upsert(self, key: str, kind: str, value) -> None:
        """A whole map, slice or set at once."""
        self.put(key, kind, {canonical(v): v for v in value} if kind == "set" else dict(value) if kind == "map" else list(value))

    def whole_of(self, key: str, kind: str):
        """A copy of a map, a slice or a set's members, or None."""
        v = self.have(key, kind)
        return None if v is None else [x for _, x in sorted(v.items())] if kind == "set" else type(v)(v)

    def bytes_of(self, key: str) -> bytes | None:
        v = self.have(key, "string")
        return None if v is None else v.encode()

    def entries(self, prefix: str = "") -> list[tuple[str, object]]:
        """(key, shown value) of the live keys under a prefix, in byte order."""
        return [(k, self.shown(k)) for k in sorted(self.data, key=str.encode) if k.startswith(prefix) and self.kind(k) is not None]

    # keys, strings, counters

    def shown(self, key: str):
        kind = self.kind(key)
        if kind is None:
            return None
        v = self.data[key][1]
        views = {"slice": lambda: v, "set": lambda: [x for _, x in sorted(v.items())], "priority_queue": lambda: [{"priority": p, "value": x} for p, _, x in sorted(v[1], key=lambda t: t[:2])], "top_k": lambda: v.ranked(), "roaring_bitmap": lambda: v, "sparse_bitset": lambda: v, "radix_tree": lambda: dict(sorted(v.items(), key=lambda x: x[0].encode())), "fenwick_tree": lambda: v["cells"], "reservoir_sample": lambda: self.sample(v)}
        return views[kind]() if kind in views else v if isinstance(v, (str, int, dict)) and kind in ("string", "counter", "map") else f"<{kind}>"

    def do_get(self, key, c):
        v = self.shown(key)
        return ("key not found", None) if v is None else ("ok", v)

    def do_dump(self, key, c):
        kind = self.kind(key)
        return ("key not found", None) if kind is None else ("ok", {"type": kind, "value": self.shown(key), "expires_at": self.expiry.get(key)})

    def do_exists(self, key, c):
        return "ok", "0" if self.kind(key) is None else "1"

    def do_set(self, key, c):
        self.drop(key)
        self.put(key, "string", c.get("value") or "")
        return self.expire(key, c, "stored string")

    def do_setx(self, key, c):
        ttl = self.ttl_of(c)
        self.do_set(key, {"value": c.get("value")})
        self.expiry[key] = self.clock() + ttl
        return "stored string with ttl", None

    def do_setint(self, key, c):
        n = whole(c.get("value"), "value must be a 32-bit integer", INT32)
        self.drop(key)
        self.put(key, "counter", n)
        return self.expire(key, c, "stored counter")

    def do_setintx(self, key, c):
        n, ttl = whole(c.get("value"), "value must be a 32-bit integer", INT32), self.ttl_of(c)
        self.drop(key)
        self.put(key, "counter", n)
        self.expiry[key] = self.clock() + ttl
        return "stored counter with ttl", None

    def do_inc(self, key, c):
        by = 1 if c.get("value") in (None, "") else whole(c["value"], "value must be a 32-bit integer", INT32)
        n = (self.have(key, "counter") or 0) + by
        if n not in INT32:
            raise Refused("counter overflow")
        return "incremented", self.put(key, "counter", n)

    def do_del(self, key, c):
        self.kind(key)
        return ("deleted" if self.drop(key) else "key not found"), None

    def do_ttl(self, key, c):
        self.kind(key)
        return "ok", str(int(self.expiry[key] - self.clock())) if key in self.expiry else "-1"

    def do_expire(self, key, c):
        ttl = self.ttl_of(c)
        if self.kind(key) is None:
            return "key not found", None
        self.expiry[key] = self.clock() + ttl
        return "ttl updated", None

    def do_expireat(self, key, c):
        at = c.get("unix_seconds") or whole(c.get("value"), "unix_seconds or integer value is required")
        if self.kind(key) is None:
            return "key not found", None
        self.expiry[key] = float(at)
        self.kind(key)
        return "ttl updated", None

    def do_persist(self, key, c):
        self.kind(key)
        return ("key not found or no ttl" if self.expiry.pop(key, None) is None else "ttl removed"), None

    # maps, deques, sets, queues

    def do_putmap(self, key, c):
        self.need(key, "map", dict).update(self.fields(c))
        return "stored map fields", None

    def do_peekmap(self, key, c):
        return self.found((self.have(key, "map") or {}).get(self.subkey(c)))

    def do_takemap(self, key, c):
        return self.found((self.have(key, "map") or {}).pop(self.subkey(c), None), "removed")

    def do_pushslice(self, key, c):
        self.need(key, "slice", list).extend(self.values(c))
        return "pushed slice values", None

    def end(self, key, place: int, take: bool):
        v = self.have(key, "slice")
        if not v:
            return "value not found", None
        return ("removed", v.pop(place)) if take else ("ok", v[place])

    def do_popslice(self, key, c):
        return self.end(key, -1, True)

    def do_shiftslice(self, key, c):
        return self.end(key, 0, True)

    def do_headslice(self, key, c):
        return self.end(key, 0, False)

    def do_tailslice(self, key, c):
        return self.end(key, -1, False)

    def do_addset(self, key, c):
        values = self.values(c)
        own = self.need(key, "set", dict)
        before = len(own)
        for v in values:
            own.setdefault(canonical(v), v)
        return "added set values", str(len(own) - before)

    def do_remset(self, key, c):
        own = self.have(key, "set") or {}
        return "removed set values", str(sum(own.pop(canonical(v), None) is not None for v in self.values(c)))

    def do_hasset(self, key, c):
        return "ok", str(int(canonical(self.values(c)[0]) in (self.have(key, "set") or {})))

    def do_getset(self, key, c):
        return self.found(None if self.have(key, "set") is None else self.shown(key))

    def do_pushpq(self, key, c):
        if c.get("priority") is None:
            raise Refused("priority is required")
        values, own = self.values(c), self.need(key, "priority_queue", lambda: [0, []])
        for v in values:
            heapq.heappush(own[1], (int(c["priority"]), own[0], v))
            own[0] += 1
        return "pushed priority queue values", str(len(values))

    def first(self, key, take: bool):
        own = self.have(key, "priority_queue")
        if not own or not own[1]:
            return "value not found", None
        p, _, v = heapq.heappop(own[1]) if take else own[1][0]
        return ("removed" if take else "ok"), {"priority": p, "value": v}

    def do_peekpq(self, key, c):
        return self.first(key, False)

    def do_poppq(self, key, c):
        return self.first(key, True)

    def do_getpq(self, key, c):
        return self.found(None if self.have(key, "priority_queue") is None else self.shown(key))

    # filters

    def shape(self, c: dict, size: int, rate: float) -> tuple[int, float]:
        n = whole(c["value"], "capacity must be a positive integer", range(1, 1 << 40)) if c.get("value") else size
        given = (c.get("subkey") or "").strip()
        try:
            p = float(given) if given else rate
        except ValueError:
            raise Refused("rate must be a number between 0 and 1") from None
        if not 0 < p < 1:
            raise Refused("rate must be a number between 0 and 1")
        return n, p

    def bloom(self, n: int = 10_000, p: float = 0.01) -> dict:
        s = BloomShape.of(n, p)
        return {"shape": s, "bits": set(), "insertions": 0}

    def bits_of(self, value, s: BloomShape) -> list[int]:
        raw = canonical(value)
        a, b = fnv1a(raw), fnv1(raw) | 1
        return [(a + i * b & MASK) % s.bits for i in range(s.hashes)]

    def do_createbf(self, key, c):
        made = self.bloom(*self.shape(c, 10_000, 0.01))
        self.drop(key)
        self.put(key, "bloom_filter", made)
        return "created bloom filter", None

    def do_addbf(self, key, c):
        values, own, added = self.values(c), self.need(key, "bloom_filter", self.bloom), 0
        for v in values:
            bits = self.bits_of(v, own["shape"])
            added += not own["bits"].issuperset(bits)
            own["bits"].update(bits)
            own["insertions"] += 1
        return "added bloom filter values", str(added)

    def do_hasbf(self, key, c):
        own = self.have(key, "bloom_filter")
        return "ok", str(int(own is not None and own["bits"].issuperset(self.bits_of(self.values(c)[0], own["shape"]))))

    def do_infobf(self, key, c):
        own = self.have(key, "bloom_filter")
        if own is None:
            return "value not found", None
        s, fill = own["shape"], len(own["bits"]) / own["shape"].bits
        return "ok", {"bit_count": s.bits, "bit_bytes": -(-s.bits // 8), "hash_count": s.hashes, "insertions": own["insertions"], "set_bits": len(own["bits"]), "fill_ratio": fill, "estimated_false_positive_rate": fill**s.hashes}

    def do_createcf(self, key, c):
        made = Cuckoo(*self.shape(c, 10_000, 0.01))
        self.drop(key)
        self.put(key, "cuckoo_filter", made)
        return "created cuckoo filter", None

    def do_addcf(self, key, c):
        own, added = self.need(key, "cuckoo_filter", Cuckoo), 0
        for v in self.values(c):
            got = own.add(fnv1a(canonical(v)))
            if got is None:
                raise Refused("cuckoo filter is full")
            added += got
        return "added cuckoo filter values", str(added)

    def do_hascf(self, key, c):
        own = self.have(key, "cuckoo_filter")
        return "ok", str(int(own is not None and own.has(fnv1a(canonical(self.values(c)[0])))))

    def do_delcf(self, key, c):
        own = self.have(key, "cuckoo_filter")
        return "removed cuckoo filter values", str(sum(own.remove(fnv1a(canonical(v))) for v in self.values(c)) if own is not None else 0)

    def do_infocf(self, key, c):
        own = self.have(key, "cuckoo_filter")
        if own is None:
            return "value not found", None
        room = own.buckets * own.SLOTS
        return "ok", {"bucket_count": own.buckets, "bucket_size": own.SLOTS, "capacity": room, "count": own.count, "fingerprint_bits": own.bits, "load_factor": own.count / room, "estimated_false_positive_rate": 1 - (1 - 2.0**-own.bits) ** (2 * own.SLOTS)}

    def do_createxf(self, key, c):
        n = whole(c["value"], "expected items must be a non-negative integer", range(0, 1 << 40)) if c.get("value") else 0
        self.drop(key)
        self.put(key, "xor_filter", {"expected": n, "staged": {}, "built": None})
        return "created xor filter", None

    def do_addxf(self, key, c):
        own = self.need(key, "xor_filter", lambda: {"expected": 0, "staged": {}, "built": None})
        if own["built"] is not None:
            raise Refused("xor filter is already built")
        before = len(own["staged"])
        own["staged"].update((canonical(v), v) for v in self.values(c))
        return "staged xor filter values", str(len(own["staged"]) - before)

    def do_buildxf(self, key, c):
        own = self.have(key, "xor_filter")
        if own is None:
            return "value not found", None
        if own["built"] is None:
            own["built"] = Xor([fnv1a(k) for k in own["staged"]])
        return "built xor filter", self.do_infoxf(key, c)[1]

    def do_hasxf(self, key, c):
        values, own = self.values(c), self.have(key, "xor_filter")
        if own is None:
            return "value not found", None
        if own["built"] is None:
            raise Refused("xor filter is not built")
        return "ok", str(int(own["built"].has(fnv1a(canonical(values[0])))))

    def do_infoxf(self, key, c):
        own = self.have(key, "xor_filter")
        if own is None:
            return "value not found", None
        f = own["built"]
        return "ok", {"expected_items": own["expected"], "items": f.items if f else 0, "staged": 0 if f else len(own["staged"]), "built": f is not None, "fingerprint_bits": 8, "fingerprint_count": len(f.table) if f else 0, "load_factor": f.items / len(f.table) if f else 0.0, "estimated_false_positive_rate": 1 / 256}

    # bitmaps

    def ids(self, c: dict, bits: int) -> list[int]:
        return [whole(v, f"value must be an unsigned {bits}-bit integer", range(0, 1 << bits)) for v in self.values(c)]

    def bitmap(self, key, c, kind: str, bits: int, name: str, verb: str):
        if verb == "create":
            self.drop(key)
            self.put(key, kind, [])
            return f"created {name}", None
        if verb in ("add", "rem", "has"):
            ids = self.ids(c, bits)
            own = self.need(key, kind, list) if verb == "add" else self.have(key, kind) or []
            there = lambda x: (i := bisect_left(own, x)) < len(own) and own[i] == x
            if verb == "has":
                return "ok", str(int(there(ids[0])))
            changed = 0
            for x in ids:
                if verb == "add" and not there(x):
                    insort(own, x)
                    changed += 1
                elif verb == "rem" and there(x):
                    own.pop(bisect_left(own, x))
                    changed += 1
            return f"{'added' if verb == 'add' else 'removed'} {name} values", str(changed)
        own = self.have(key, kind)
        if own is None:
            return "value not found", None
        if verb == "count":
            return "ok", str(len(own))
        if verb == "get":
            return "ok", own
        sizes = np.unique(np.array([x >> 16 for x in own], np.uint64), return_counts=True)[1] if own else np.zeros(0)
        return "ok", {"cardinality": len(own), "containers": len(sizes), "array_containers": int((sizes <= 4096).sum()), "bitmap_containers": int((sizes > 4096).sum())}

    # ordered maps

    def do_creatert(self, key, c):
        self.drop(key)
        self.put(key, "radix_tree", {})
        return "created radix tree", None

    def do_putrt(self, key, c):
        fields, own = self.fields(c), self.need(key, "radix_tree", dict)
        added = sum(k not in own for k in fields)
        own.update(fields)
        return "stored radix tree values", str(added)

    def do_getrt(self, key, c):
        return self.found((self.have(key, "radix_tree") or {}).get(self.subkey(c)))

    def do_delrt(self, key, c):
        return "removed radix tree value", str(int((self.have(key, "radix_tree") or {}).pop(self.subkey(c), None) is not None))

    def do_hasrt(self, key, c):
        return "ok", str(int(self.subkey(c) in (self.have(key, "radix_tree") or {})))

    def do_prefixrt(self, key, c):
        own = self.have(key, "radix_tree")
        if own is None:
            return "value not found", None
        prefix = c.get("subkey") or c.get("value") or ""
        return "ok", [{"key": k, "value": v} for k, v in sorted(own.items(), key=lambda x: x[0].encode()) if k.startswith(prefix)]

    def do_infort(self, key, c):
        own = self.have(key, "radix_tree")
        return self.found(None if own is None else {"items": len(own)})

    # counting sketches

    def cms(self, width: int = 2048, depth: int = 4) -> dict:
        return {"grid": np.zeros((depth, width), np.uint64), "total": 0}

    def cells(self, value, grid) -> tuple[np.ndarray, np.ndarray]:
        raw = canonical(value)
        a, b = fnv1a(raw), fnv1(raw) | 1
        return np.arange(len(grid)), np.array([(a + i * b & MASK) % grid.shape[1] for i in range(len(grid))])

    def do_createcms(self, key, c):
        width = whole(c["value"], "width must be a positive integer", range(1, (1 << 24) + 1)) if c.get("value") else 2048
        depth = whole(c["subkey"], "depth must be 1 to 64", range(1, 65)) if c.get("subkey") else 4
        if width * depth > 1 << 24:
            raise Refused("count-min sketch is too large")
        self.drop(key)
        self.put(key, "count_min_sketch", self.cms(width, depth))
        return "created count-min sketch", None

    def times(self, c: dict) -> int:
        given = (c.get("pairs") or {}).get("count") or c.get("subkey") or 1
        return whole(given, "count must be a positive integer", range(1, 1 << 32))

    def do_incrcms(self, key, c):
        values, n, own = self.values(c), self.times(c), self.need(key, "count_min_sketch", self.cms)
        for v in values:
            at = self.cells(v, own["grid"])
            own["grid"][at] = np.minimum(own["grid"][at] + np.uint64(n), np.uint64((1 << 32) - 1))
            own["total"] += n
        if c.get("values") or len(values) > 1:
            return "incremented count-min sketch values", str(len(values))
        return "incremented count-min sketch", str(int(own["grid"][self.cells(values[0], own["grid"])].min()))

    def do_estcms(self, key, c):
        values, own = self.values(c), self.have(key, "count_min_sketch")
        return self.found(None if own is None else str(int(own["grid"][self.cells(values[0], own["grid"])].min())))

    def do_infocms(self, key, c):
        own = self.have(key, "count_min_sketch")
        if own is None:
            return "value not found", None
        g = own["grid"]
        return "ok", {"width": g.shape[1], "depth": g.shape[0], "counter_bytes": 4 * g.size, "total_count": own["total"], "max_counter": int(g.max()), "saturated_counters": int((g == (1 << 32) - 1).sum())}

    def hll(self, p: int = 14) -> dict:
        return {"p": p, "registers": np.zeros(1 << p, np.uint8), "seen": 0}

    def do_createhll(self, key, c):
        p = whole(c["value"], "precision must be 4 to 20", range(4, 21)) if c.get("value") else 14
        self.drop(key)
        self.put(key, "hyperloglog", self.hll(p))
        return "created hyperloglog", None

    def estimate(self, own: dict) -> int:
        r, m = own["registers"], len(own["registers"])
        alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
        raw, empty = alpha * m * m / float((2.0 ** -r.astype(float)).sum()), int((r == 0).sum())
        return round(m * math.log(m / empty) if raw <= 2.5 * m and empty else raw)

    def do_addhll(self, key, c):
        values, own = self.values(c), self.need(key, "hyperloglog", self.hll)
        for v in values:
            h = fnv1a(canonical(v))
            at, rest = h & (1 << own["p"]) - 1, h >> own["p"]
            own["registers"][at] = max(own["registers"][at], 64 - own["p"] - rest.bit_length() + 1)
            own["seen"] += 1
        return "added hyperloglog values", str(self.estimate(own))

    def do_counthll(self, key, c):
        own = self.have(key, "hyperloglog")
        return self.found(None if own is None else str(self.estimate(own)))

    def do_infohll(self, key, c):
        own = self.have(key, "hyperloglog")
        return self.found(None if own is None else {"precision": own["p"], "register_count": len(own["registers"]), "register_bytes": len(own["registers"]), "observations": own["seen"], "non_zero_registers": int((own["registers"] > 0).sum()), "estimate": self.estimate(own)})

    def do_createtopk(self, key, c):
        n = whole(c["value"], "capacity must be 1 to 1048576", range(1, (1 << 20) + 1)) if c.get("value") else 100
        self.drop(key)
        self.put(key, "top_k", SpaceSaving(n))
        return "created top-k", None

    def do_addtopk(self, key, c):
        values, n, own = self.values(c), self.times(c), self.need(key, "top_k", lambda: SpaceSaving(100))
        for v in values:
            last = own.add(v, n)
        if len(values) == 1:
            return "added top-k value", {"tracked": True, "count": last[1], "error": last[2]}
        return "added top-k values", str(len(values))

    def do_esttopk(self, key, c):
        own = self.have(key, "top_k")
        hit = own.items.get(canonical(self.values(c)[0])) if own is not None else None
        return "ok", {"tracked": hit is not None, "count": hit[1] if hit else 0, "error": hit[2] if hit else 0}

    def do_gettopk(self, key, c):
        own = self.have(key, "top_k")
        return self.found(None if own is None else own.ranked())

    def do_infotopk(self, key, c):
        own = self.have(key, "top_k")
        if own is None:
            return "value not found", None
        counts = [x[1] for x in own.items.values()]
        return "ok", {"capacity": own.capacity, "tracked": len(counts), "total": own.total, "min_count": min(counts, default=0), "max_count": max(counts, default=0)}

    # samples, quantiles, prefix sums

    def do_creaters(self, key, c):
        n = whole(c["value"], "capacity must be 1 to 1048576", range(1, (1 << 20) + 1)) if c.get("value") else 128
        self.drop(key)
        self.put(key, "reservoir_sample", {"k": n, "seen": 0, "items": []})
        return "created reservoir sample", None

    def sample(self, own: dict) -> list:
        return [{"value": v, "priority": -p, "sequence": -s} for p, s, v in sorted(own["items"], key=lambda t: (-t[0], -t[1]))]

    def do_addrs(self, key, c):
        values, own = self.values(c), self.need(key, "reservoir_sample", lambda: {"k": 128, "seen": 0, "items": []})
        accepted = False
        for v in values:
            own["seen"] += 1
            rank = (-fnv1a(own["seen"].to_bytes(8, "little") + canonical(v)), -own["seen"], v)
            if len(own["items"]) < own["k"]:
                heapq.heappush(own["items"], rank)
                accepted = True
            elif rank[:2] > own["items"][0][:2]:
                heapq.heapreplace(own["items"], rank)
                accepted = True
        return "added reservoir sample values", {"accepted": accepted, "seen": own["seen"], "tracked": len(own["items"]), "capacity": own["k"]}

    def do_getrs(self, key, c):
        own = self.have(key, "reservoir_sample")
        return self.found(None if own is None else self.sample(own))

    def do_infors(self, key, c):
        own = self.have(key, "reservoir_sample")
        if own is None:
            return "value not found", None
        ranks = [-p for p, _, _ in own["items"]]
        return "ok", {"capacity": own["k"], "tracked": len(ranks), "seen": own["seen"], "min_priority": min(ranks, default=0), "max_priority": max(ranks, default=0)}

    def do_createq(self, key, c):
        try:
            epsilon = float(c["value"]) if c.get("value") else 0.01
        except ValueError:
            raise Refused("epsilon must be 0.0001 to 0.5") from None
        if not 1e-4 <= epsilon <= 0.5:
            raise Refused("epsilon must be 0.0001 to 0.5")
        self.drop(key)
        self.put(key, "quantile_sketch", Quantiles(epsilon))
        return "created quantile sketch", None

    def number(self, v) -> float:
        try:
            x = float(v)
        except (TypeError, ValueError):
            raise Refused("value must be a finite number") from None
        if not math.isfinite(x):
            raise Refused("value must be a finite number")
        return x

    def quantile(self, own: Quantiles, q: float) -> dict:
        return {"quantile": q, "value": own.at(q), "count": own.n, "rank_error": math.ceil(own.epsilon * own.n)}

    def do_addq(self, key, c):
        numbers = [self.number(v) for v in self.values(c)]
        own = self.need(key, "quantile_sketch", lambda: Quantiles(0.01))
        for x in numbers:
            own.add(x)
        return "added quantile sketch values", self.quantile(own, 0.5)

    def do_estq(self, key, c):
        q, own = self.number(c.get("value")), self.have(key, "quantile_sketch")
        return self.found(None if own is None or not own.n else self.quantile(own, q))

    def do_infoq(self, key, c):
        own = self.have(key, "quantile_sketch")
        if own is None:
            return "value not found", None
        return "ok", {"epsilon": own.epsilon, "count": own.n, "summary_size": len(own.entries), "min": own.low if own.n else 0, "max": own.high if own.n else 0, "rank_error": math.ceil(own.epsilon * own.n)}

    def do_createfw(self, key, c):
        n = whole(c.get("value"), "size must be 1 to 1048576", range(1, (1 << 20) + 1))
        self.drop(key)
        self.put(key, "fenwick_tree", {"cells": [0] * n, "tree": [0] * (n + 1), "total": 0, "updates": 0})
        return "created fenwick tree", None

    def place(self, text, own: dict | None) -> int | None:
        n = whole(text, "index must be a non-negative integer", range(0, 1 << 62))
        return n if own is not None and n < len(own["cells"]) else None

    def do_addfw(self, key, c):
        own = self.have(key, "fenwick_tree")
        at, delta = self.place(c.get("subkey"), own), whole(c.get("value"), "delta must be a 64-bit integer", INT64)
        if at is None:
            raise Refused("fenwick tree update is out of range or overflows")
        nodes, k = [], at + 1
        while k < len(own["tree"]):
            nodes.append(k)
            k += k & -k
        if any(v + delta not in INT64 for v in (own["cells"][at], own["total"], *(own["tree"][k] for k in nodes))):
            raise Refused("fenwick tree update is out of range or overflows")
        for k in nodes:
            own["tree"][k] += delta
        own["cells"][at] += delta
        own["total"] += delta
        own["updates"] += 1
        return "updated fenwick tree", {"index": at, "delta": delta, "value": own["cells"][at], "prefix_sum": self.prefix(own, at), "total": own["total"], "updates": own["updates"]}

    def prefix(self, own: dict, at: int) -> int:
        """Sum of the cells up to `at`, by the tree."""
        out, k = 0, at + 1
        while k:
            out += own["tree"][k]
            k -= k & -k
        return out

    def do_getfw(self, key, c):
        own = self.have(key, "fenwick_tree")
        at = self.place(c.get("subkey") or c.get("value"), own)
        return self.found(None if at is None else str(own["cells"][at]))

    def do_sumfw(self, key, c):
        own = self.have(key, "fenwick_tree")
        at = self.place(c.get("subkey") or c.get("value"), own)
        return self.found(None if at is None else str(self.prefix(own, at)))

    def do_rangefw(self, key, c):
        own = self.have(key, "fenwick_tree")
        a, b = self.place(c.get("subkey"), own), self.place(c.get("value"), own)
        return self.found(None if a is None or b is None or a > b else str(self.prefix(own, b) - (self.prefix(own, a - 1) if a else 0)))

    def do_infofw(self, key, c):
        own = self.have(key, "fenwick_tree")
        return self.found(None if own is None else {"size": len(own["cells"]), "updates": own["updates"], "total": own["total"], "tree_bytes": 8 * (len(own["cells"]) + 1)})


def _bitmap_commands() -> None:
    for suffix, kind, bits, name in (("rb", "roaring_bitmap", 32, "roaring bitmap"), ("sb", "sparse_bitset", 64, "sparse bitset")):
        for verb in ("create", "add", "rem", "has", "count", "get", "info"):
            setattr(Store, f"do_{verb}{suffix}", lambda self, key, c, k=kind, b=bits, n=name, v=verb: self.bitmap(key, c, k, b, n, v))


_bitmap_commands()

COMMANDS = sorted(x[3:].upper() for x in dir(Store) if x.startswith("do_")) + ["BATCH"]
LOG = "seq long, command string, key string, subkey string, value string, values array<string>, pairs map<string,string>, ttl_seconds double, unix_seconds double, priority long"


#: White space at the ends of keys, as `run` strips it.
ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def apply_log(log: DataFrame, now: float | None = None) -> DataFrame:
    """Rows (seq, ok, message, value), a response for each command of the log (columns as in LOG).

    Keys run in parallel, each in order of seq; `now` fixes the clock. Spellings of a key that differ in white space at the
    ends are one key. A key's commands are one task's work: logs with hot keys of commutative commands belong to the
    aggregations in operators.sets and operators.sketches.

    A log with a column `batch` (array of structs of LOG's fields without seq) can hold BATCH commands: theirs run at the
    batch's place in each key's order, without a transaction; `value` is then the JSON array of their responses.
    """
    at = time.time() if now is None else now
    names = [c.split()[0] for c in LOG.split(", ")]
    fields = [n for n in names if n != "seq"]
    if "batch" not in log.columns:
        return folded(log.select(*names, F.lit(0).alias("part")), at).select("seq", "ok", "message", "value")
    is_batch = F.coalesce(F.upper(F.regexp_replace("command", ENDS, "")) == "BATCH", F.lit(False))
    single = folded(log.where(~is_batch).select(*names, F.lit(-1).alias("part")), at, log.where(is_batch).select("seq", F.posexplode("batch").alias("part", "c")).select("seq", *(F.col(f"c.{n}").alias(n) for n in fields), "part"), names)
    fits = F.coalesce(F.size("batch"), F.lit(0)).between(1, MOST_BATCH)
    wrong = log.where(is_batch & ~fits).select("seq", F.lit(False).alias("ok"), F.lit(f"batch must have 1 to {MOST_BATCH} commands").alias("message"), F.lit(None).cast("string").alias("value"))
    allowed = log.where(is_batch & fits).select("seq")
    parts = single.where("part >= 0").join(allowed, "seq", "left_semi").groupBy("seq").agg(F.min("ok").alias("ok"), F.lit("batch executed").alias("message"), F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("part", "ok", "message", "value"))), lambda r: F.struct(r["ok"].alias("ok"), r["message"].alias("message"), r["value"].alias("value")))).alias("value"))
    return single.where("part < 0").select("seq", "ok", "message", "value").union(parts.select("seq", "ok", "message", "value")).union(wrong)


def folded(log: DataFrame, at: float, more: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """Responses (seq, part, ok, message, value) of commands, key by key in order of (seq, part)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        store = Store(lambda: at)
        out = []
        for r in rows.sort_values(["seq", "part"]).to_dict("records"):
            c = {k: v for k, v in r.items() if not (v is None or isinstance(v, float) and math.isnan(v))}
            c["values"] = list(c["values"]) if c.get("values") is not None else None
            c["pairs"] = dict(c["pairs"]) if c.get("pairs") is not None else None
            got = {"ok": False, "message": "nested batch", "value": None} if r["part"] >= 0 and normal(c.get("command")) == "BATCH" else store.run(c)
            out.append((r["seq"], r["part"], got["ok"], got["message"], got["value"]))
        return pd.DataFrame(out, columns=["seq", "part", "ok", "message", "value"])

    if more is not None:
        columns = [*names, "part"]
        log = log.select(*columns).unionByName(more.select(*columns))
    # Pandas would make doubles of nullable longs: priorities go as text.
    return log.withColumn("priority", F.col("priority").cast("string")).groupBy(F.regexp_replace("key", ENDS, "").alias("_key")).applyInPandas(run, "seq long, part int, ok boolean, message string, value string")


__all__ = ["COMMANDS", "LOG", "Store", "apply_log", "canonical", "normal"]
