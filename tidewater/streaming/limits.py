"""More stream rules: prefix limits, announces with expiry, the next-sample schedule, node tables. See ``stateful`` for how they run."""

from __future__ import annotations

import ipaddress
from typing import Any

# IPv6 prefixes that a client is limited on, with the factor of the quota for each.
V6_FACTORS = ((64, 1), (56, 4), (48, 16), (32, 64))


def prefixes(ip: str) -> list[tuple[str, int]]:
    """(prefix, factor) of each bucket that a request is charged to; the last is the widest, by which state may be keyed."""
    address = ipaddress.ip_address(ip)
    if address.version == 6 and address.ipv4_mapped:
        address = address.ipv4_mapped
    if address.version == 4:
        return [(f"{address}/32", 1)]
    return [(str(ipaddress.ip_network((int(address) >> (128 - n) << (128 - n), n))), f) for n, f in V6_FACTORS]


def widest(ip: str) -> str:
    return prefixes(ip)[-1][0]


class PrefixLimit:
    """A burst, then so many a second, on every prefix of the client at once: charged only if all of them allow it.

    Events are those of one widest prefix (``row.ip``), so a key's state holds all its narrower ones; idle ones are forgotten.
    """

    outputs = "allowed boolean, wait double"

    def __init__(self, per_second: float = 3, burst: int = 30, idle: float = 600):
        self.per_second, self.burst, self.idle = per_second, burst, idle

    def start(self) -> Any:
        return {}

    def event(self, state, at, row):
        state = {p: e for p, e in state.items() if at - e[1] < self.idle}
        charges, wait = {}, 0.0
        for prefix, factor in prefixes(row.ip):
            emission = 1.0 / (self.per_second * factor)
            after = max(state.get(prefix, [at, at])[0], at) + emission
            wait = max(wait, after - at - emission * self.burst * factor)
            charges[prefix] = [after, at]
        if wait > 1e-9:
            return (False, round(wait, 6)), {p: [e[0], at if p in charges else e[1]] for p, e in state.items()}
        return (True, 0.0), state | charges


class Announces:
    """Announces of a key (``row.peer, host, subnet, seed``): one entry an address, so many a host, so many in all, each with an expiry.

    A full host gives up its oldest entry; a full key the oldest of its busiest subnet (ties: the one with the oldest entry).
    """

    outputs = "stored string, live int, seeds int"

    def __init__(self, ttl: float = 2700, per_host: int = 4, most: int = 100):
        self.ttl, self.per_host, self.most = ttl, per_host, most

    def start(self) -> Any:
        return []

    def event(self, state, at, row):
        mine = [row.peer, row.host, row.subnet, bool(row.seed), at]
        same = [e for e in state if e[0] == row.peer]
        live = [e for e in state if at - e[4] < self.ttl and e[0] != row.peer]
        kind = "refreshed" if same else "added"
        if not same:
            of_host = [e for e in live if e[1] == row.host]
            victim = None
            if len(of_host) >= self.per_host:
                victim = min(of_host, key=lambda e: e[4])
            elif len(live) >= self.most:
                counts: dict = {}
                for e in live:
                    n, oldest = counts.get(e[2], (0, e[4]))
                    counts[e[2]] = (n + 1, min(oldest, e[4]))
                busiest = min(counts, key=lambda s: (-counts[s][0], counts[s][1], s))
                victim = min((e for e in live if e[2] == busiest), key=lambda e: e[4])
            if victim is not None:
                live.remove(victim)
                kind = "replaced"
        live.append(mine)
        return (kind, len(live), sum(e[3] for e in live)), live


class NextSample:
    """When a node may be asked again (``row.outcome, interval``): never earlier than was said before; timeouts climb a ladder."""

    outputs = "asked boolean, next_at double"

    def __init__(self, floor: float = 300, ceiling: float = 21_600):
        self.floor, self.ceiling = floor, ceiling

    def start(self) -> Any:
        return [0.0, 0]

    def event(self, state, at, row):
        following, strikes = state
        if at < following:
            return (False, following), state
        strikes = strikes + 1 if row.outcome == "timeout" else 0
        if row.outcome == "answer":
            wait = min(max(row.interval if row.interval is not None and row.interval == row.interval else self.ceiling, self.floor), self.ceiling)
        elif row.outcome == "timeout":
            wait = min(self.floor * 2 ** (strikes - 1), self.ceiling)
        else:
            wait = self.ceiling
        return (True, at + wait), [max(following, at + wait), strikes]


class NodeTable:
    """Nodes of one family near ``own`` (``row.id, subnet, answered, valid``): buckets by shared prefix, K each, one a subnet, and K in reserve.

    Only the bucket that would hold ``own`` splits, which is what a bucket for each prefix length amounts to once it is full. A node
    that has answered may take the place of a bad one, or, if its id proves its address, of one whose id does not. Others wait.
    """

    outputs = "placed string, members int"
    K, BAD, RECENT = 8, 2, 900.0

    def __init__(self, own: bytes):
        self.own = int.from_bytes(own, "big")

    def start(self) -> Any:
        return {"nodes": {}, "depth": 0}

    def _bucket(self, id_: str, depth: int) -> int:
        return min(160 - (int(id_, 16) ^ self.own).bit_length(), depth)

    def _status(self, node: list, at: float) -> str:
        if node[2] >= (self.BAD if node[3] else 1):
            return "bad"
        return "good" if node[2] == 0 and node[3] and at - node[1] < self.RECENT else "questionable"

    def event(self, state, at, row):
        nodes, depth = state["nodes"], state["depth"]
        id_ = bytes(row.id).hex()
        count = lambda: sum(n[5] for n in nodes.values())
        if int(id_, 16) == self.own:
            return ("refused", count()), state
        node = nodes.get(id_)
        if node is not None and node[0] == row.subnet:
            node[1] = at
            node[2] = 0 if row.answered else node[2] + 1
            node[3] = node[3] or bool(row.answered)
            if node[5]:
                return ("updated", count()), state
        node = [row.subnet, at, 0 if row.answered else 1, bool(row.answered), bool(row.valid), False]
        placed = "reserve"
        while True:
            mine = self._bucket(id_, depth)
            members = {i: n for i, n in nodes.items() if n[5] and self._bucket(i, depth) == mine}
            rival = next((i for i, n in members.items() if n[0] == row.subnet), None)
            bad = next((i for i in sorted(members) if self._status(members[i], at) == "bad"), None)
            if not node[4]:
                break
            if rival is not None:
                if node[3] and self._status(members[rival], at) == "bad":
                    del nodes[rival]
                    node[5], placed = True, "replaced"
                else:
                    placed = "refused"
            elif len(members) < self.K:
                node[5], placed = True, "added"
            elif bad is not None and node[3]:
                del nodes[bad]
                node[5], placed = True, "replaced"
            elif mine == depth and depth < 160:
                depth += 1
                continue
            elif node[3] and (unproven := [i for i, n in members.items() if not n[4]]):
                victim = min(unproven, key=lambda i: (self._status(nodes[i], at) == "good", nodes[i][1]))
                nodes[victim][5] = False
                node[5], placed = True, "replaced"
            break
        if placed != "refused":
            nodes[id_] = node
            waiting = sorted((i for i, n in nodes.items() if not n[5] and self._bucket(i, depth) == mine), key=lambda i: (nodes[i][3], nodes[i][4], nodes[i][1]))
            for i in waiting[: max(len(waiting) - self.K, 0)]:
                del nodes[i]
        return (placed, count()), {"nodes": nodes, "depth": depth}


class Secrets:
    """Numbers of the current and the previous secret of announce tokens: a turn each interval, and after two missed ones neither stays."""

    outputs = "current int, previous int, turned boolean"

    def __init__(self, interval: float = 300):
        self.interval = interval

    def start(self) -> Any:
        return None

    def event(self, state, at, row):
        if state is None:
            return (1, 0, False), [1, 0, at]
        current, previous, since = state
        if at - since < self.interval:
            return (current, previous, False), state
        state = [current + 2, current + 1, at] if at - since >= 2 * self.interval else [current + 1, current, at]
        return (state[0], state[1], True), state


class Pacing:
    """When a datagram may go (``row.address, ok``): so long after the last one to its address, and at the rate of one bucket for all.

    Both waits must be within ``most``; a refused one, or one that then could not be sent (not ``ok``), gives its token and its
    place back. Events are those of one sender.
    """

    outputs = "sent boolean, wait double"

    def __init__(self, spacing: float = 1.0, rate: float = 12_000, burst: int = 12_000, most: float = 2.0):
        self.spacing, self.emission, self.burst, self.most = spacing, 1.0 / rate, burst, most

    def start(self) -> Any:
        return [{}, 0.0]

    def event(self, state, at, row):
        free, arrival = state
        free = {a: t for a, t in free.items() if t > at}
        slot = max(free.get(row.address, at), at)
        following = max(arrival, at) + self.emission
        wait = max(slot - at, following - at - self.emission * self.burst, 0.0)
        if wait > self.most + 1e-9 or not row.ok:
            return (False, round(wait, 6)), [free, arrival]
        return (True, round(wait, 6)), [free | {row.address: at + wait + self.spacing}, following]


class Destination:
    """Connections to one address (``row.kind`` start or end, ``outcome`` of an end): so many at once, so many begun in ``seconds``, and none for
    a while after a failure. An end that connected shuts nothing."""

    outputs = "allowed boolean, active int"
    SHUT = {"refused": 180, "timeout": 180, "error": 600}  # fixed values

    def __init__(self, active: int = 2, begun: int = 10, seconds: float = 60):
        self.active, self.begun, self.seconds = active, begun, seconds

    def start(self) -> Any:
        return [0, [], 0.0]

    def event(self, state, at, row):
        active, recent, shut = state
        recent = [t for t in recent if at - t < self.seconds]
        if row.kind == "end":
            active = max(active - 1, 0)
            return (False, active), [active, recent, max(shut, at + self.SHUT[row.outcome]) if row.outcome in self.SHUT else shut]
        if at < shut or active >= self.active or len(recent) >= self.begun:
            return (False, active), [active, recent, shut]
        return (True, active + 1), [active + 1, [*recent, at], shut]
