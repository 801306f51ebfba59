"""HTML extraction by inference of union-free regular expressions, one host at a time.

A page is a stream of tokens: tags (name and class) and the texts between them; scripts,
styles and comments are left out. A *wrapper* is a regular expression without unions over
such tokens: tags, constant texts, text slots, optional runs and repeated units. It begins
as one page. Each further page that it doesn't accept is aligned with it, and mismatches
are resolved: two different texts make a slot; a stretch that only one side has, and that
continues a neighbouring stretch of the same shape, makes that shape a repeated unit; any
other such stretch becomes optional. Every resolution only widens what is accepted, so
the wrapper of a host accepts all its pages. A page whose tags have little in common with
a host's wrappers begins another one. A constant text that only one page has is no part of
a template: it is extracted as a slot is.

Wrappers merge like pages do (a page is a wrapper without slots), so each task folds the
pages that it scans into one partial result per host, and partial results are merged
``FAN_IN`` at a time: no host's pages are ever in one place, and only wrappers, which
don't grow with the number of pages, are shuffled. Acceptance is tested by the position
automaton of the wrapper, made deterministic as it is used: time is linear in the page.

Extraction reads the pages again and gives the texts that fall in slots, or that no other
page has. Wrappers are sent to all workers while they take up at most ``broadcast_limit``
bytes; beyond that pages are joined with them by host.

Defined cases: a null html gives null text and slots and trains nothing; one without
tokens gives an empty text; pages with a null url (or one without a host) are one group
of their own; rows that repeat a page_id are extracted each and a null page_id is
carried; a wrapper of one page, or of equal ones, gives all its texts, as nothing tells
data from template there; tags without an end are text; an empty table gives no row; a
slot's white space is collapsed; other columns are ignored. Which of several possible
wrappers is found depends on how the scan splits the table; that it accepts every page
doesn't.
"""

from __future__ import annotations

import html as _html
import json
import re
from bisect import bisect_left
from collections import Counter
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import remove, settle, workdir
from .textkit import slices

FAN_IN, BROADCAST_LIMIT, LEAST_LIKE = 64, 32 << 20, 0.4
TABLE_BITS = 1 << 30
_FRESH = count(-1, -1)  # numbers of optional runs that meet no other's

_TAG = re.compile(r"<(/?[a-zA-Z][\w:-]*)([^>\"']*+(?:\"[^\"]*\"[^>\"']*+|'[^']*'[^>\"']*+)*+)>")
_NAME = re.compile(r"</?[a-zA-Z][\w:-]*")
_RAW = re.compile(r"<(script|style)\b", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_MARK = re.compile(r"[>\"']")
_CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _tag_ends(page: str):
    """Where a tag that goes on at some place ends: the next ``>`` outside of quotes, of
    which one that nothing closes counts as any other character; -1 without one. Found for
    all places in one pass from the end, so that unclosed tags cost no more than others."""
    marks = [(m.start(), m[0]) for m in _MARK.finditer(page)]
    ends, later = [-1] * (len(marks) + 1), {}
    for k in range(len(marks) - 1, -1, -1):
        at, c = marks[k]
        if c == ">":
            ends[k] = at
        else:
            ends[k] = ends[later[c] + 1] if c in later else ends[k + 1]
            later[c] = k
    places = [at for at, _ in marks]
    return lambda at: ends[bisect_left(places, at)]


def tokens(page: str) -> list[tuple[str, str | None]]:
    """(symbol, text) of a page: a tag has a symbol beginning with ``<``, a text ``T``.
    Texts are as they stand in the page, without outer white space. What looks like a tag
    and never ends is text."""
    out: list[tuple[str, str | None]] = []
    at, held, ends = 0, [], None
    pos = page.find("<")
    while pos >= 0:
        c = page[pos + 1 : pos + 2]
        end, name, attributes = -1, None, None
        if c in ("!", "?"):
            stop = "-->" if page.startswith("<!--", pos) else ">"
            end = page.find(stop, pos + 4 if stop == "-->" else pos)
            end = len(page) if end < 0 else end + len(stop)
        elif c in ("s", "S") and (raw := _RAW.match(page, pos)):
            close = _RAW_END[raw[1].lower()].search(page, raw.end())
            end = close.end() if close else len(page)
        elif c == "/" or c.isalpha():
            tag = _TAG.match(page, pos) if ends is None else None
            if tag:
                name, attributes, end = tag[1], tag[2], tag.end()
            elif begin := _NAME.match(page, pos):
                ends = ends or _tag_ends(page)
                end = ends(begin.end()) + 1
                if end:
                    name, attributes = begin[0][1:], page[begin.end() : end - 1]
        if end <= pos:
            pos = page.find("<", pos + 1)
            continue
        if pos > at:
            held.append(page[at:pos])
        at = end
        pos = page.find("<", at)
        if name is None:
            continue
        if held:
            text = "".join(held).strip()
            held.clear()
            if text:
                out.append(("T", text))
        if attributes and (c := _CLASS.search(attributes)):
            out.append((f"<{name.lower()}.{c[1] or c[2] or c[3] or ''}", None))
        else:
            out.append((f"<{name.lower()}", None))
    text = ("".join(held) + page[at:]).strip()
    if text:
        out.append(("T", text))
    return out


def readable(text: str) -> str:
    """A text with its character references resolved and white space collapsed."""
    return " ".join((_html.unescape(text) if "&" in text else text).split())


# An item is (shape, body, opt). The body of a tag is None, of a constant text ONE or MANY
# (whether one page has it or several) and the text, of a slot None as well, of a repeated
# unit the tuple of its items. opt is 0 for what must be there; neighbours of one other
# number are there together or not at all.

ONE, MANY = "1", "2"


def _join_bodies(a, b, apart: bool = True):
    """Of two items of one shape, of different pages if ``apart``."""
    if isinstance(a, tuple) and isinstance(b, tuple):
        return tuple((x[0], _join_bodies(x[1], y[1], apart), 0) for x, y in zip(a, b))
    if a is None or b is None or a[1:] != b[1:]:
        return None
    return (MANY if apart else max(a[0], b[0])) + a[1:]


def page_items(stream) -> list:
    return [(s, None if t is None else ONE + t, 0) for s, t in stream]


def _units(items, found=None) -> dict[str, tuple[str, ...]]:
    """Shapes of the repeated units, by the shape of their group."""
    found = {} if found is None else found
    for shape, body, _ in items:
        if isinstance(body, tuple):
            _units(body, found)
            found[shape] = tuple(i[0] for i in body)
    return found


def fold(items: list, units: dict[str, tuple[str, ...]]) -> list:
    """Every run of copies of a unit as one repeated unit, shorter units first."""
    for group, shapes in sorted(units.items(), key=lambda u: (len(u[0]), u[0])):
        n, first = len(shapes), shapes[0]
        own = [i[0] for i in items]
        if first not in own and group not in own:
            continue
        out, at, end = [], 0, len(items)
        while at < end:
            labels, unit = [], None
            start = at
            while True:
                if at < end and own[at] == group:
                    body, label, step = items[at][1], items[at][2], 1
                elif at + n <= end and own[at] == first and tuple(own[at : at + n]) == shapes:
                    copy = items[at : at + n]
                    body = tuple((s, b, 0) for s, b, _ in copy)
                    kinds = {o for _, _, o in copy}
                    if len(kinds) > 1:
                        break
                    label, step = kinds.pop(), n
                else:
                    break
                unit = body if unit is None else _join_bodies(unit, body, False)
                labels.append(label)
                at += step
            if unit is None:
                out.append(items[start])
                at = start + 1
            else:
                label = 0 if 0 in labels else labels[0] if len(set(labels)) == 1 else next(_FRESH)
                out.append((group, unit, label))
        items = out
    return items


def _rows(a: list[str], b: list[str]):
    """For a[i:], from the last i to 0, a number whose low bit k is 0 where the longest
    common subsequence with the last k + 1 of b is longer than with the last k."""
    full = (1 << len(b)) - 1
    where: dict[str, int] = {}
    for k, s in enumerate(reversed(b)):
        where[s] = where.get(s, 0) | 1 << k
    row = full
    for s in reversed(a):
        met = row & where.get(s, 0)
        row = ((row + met) | (row - met)) & full
        yield row


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` with the last 0, 1, ... of ``b``."""
    *_, row = _rows(a, b)
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, pairs as early as they can be. Rows of its table are
    bits of an integer; a table too large to be kept is halved."""
    n, m = len(a), len(b)
    if not n or not m:
        return []
    if n * m > TABLE_BITS and n > 1:
        half = n // 2
        low, high = _lengths(a[:half][::-1], b[::-1]), _lengths(a[half:], b)
        cut = int(np.argmax(low + high[::-1]))
        return _matches(a[:half], b[:cut]) + [(half + i, cut + j) for i, j in _matches(a[half:], b[cut:])]
    table = [(1 << m) - 1, *_rows(a, b)][::-1]
    length = lambda i, j: m - j - (table[i] & ((1 << m - j) - 1)).bit_count()  # noqa: E731  # of a[i:] and b[j:]
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif length(i + 1, j) >= length(i, j + 1):
            i += 1
        else:
            j += 1
    return out


def _aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    low, most = 0, min(len(a), len(b))
    while low < most and a[low] == b[low]:
        low += 1
    tail = 0
    while tail < most - low and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    inner = _matches(a[low : len(a) - tail], b[low : len(b) - tail])
    return (
        [(k, k) for k in range(low)]
        + [(low + i, low + j) for i, j in inner]
        + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
    )


def _well_formed(unit: tuple[str, ...]) -> int:
    """2 for a unit that its first tag opens and its last closes, 1 for one that begins
    with an opening tag or is a repeated group, 0 for others."""
    first, last = unit[0], unit[-1]
    if first.startswith("</") or first == "T":
        return 0
    if last == "</" + first[1:].split(".")[0] or (len(unit) == 1 and first.startswith("(")):
        return 2
    return 1


def _period(gap: list[str]) -> int:
    for p in range(1, len(gap) + 1):
        if len(gap) % p == 0 and gap[:p] * (len(gap) // p) == gap:
            return p
    return len(gap)


def _repeated(gap: list[str], before: list[str], after: list[str]) -> tuple[str, ...] | None:
    """The unit of which ``gap`` is further copies beside ``before`` or ``after``."""
    p = _period(gap)
    best, mark = None, 0
    for turn in range(p):
        unit = gap[turn:p] + gap[:turn]
        # the gap may begin within a copy: the rest of it must then stand beside the gap
        joined = before[-p:] + gap + after[:p]
        copies, at = 0, 0
        while at + p <= len(joined):
            if joined[at : at + p] == unit:
                run = 0
                while joined[at : at + p] == unit:
                    run, at = run + 1, at + p
                copies = max(copies, run)
            else:
                at += 1
        score = _well_formed(tuple(unit))
        if copies * p > len(gap) and score > mark and not all(s == "T" for s in unit):
            best, mark = tuple(unit), score
    return best


def merge(a: list, b: list) -> list:
    """A wrapper that accepts all that ``a`` or ``b`` accepts."""
    units = _units(a)
    _units(b, units)
    while True:
        a, b = fold(a, units), fold(b, units)
        sa, sb = [i[0] for i in a], [i[0] for i in b]
        pairs = _aligned(sa, sb) + [(len(a), len(b))]
        new = None
        i = j = 0
        for x, y in pairs:
            for own, lo, hi in ((sa, i, x), (sb, j, y)):
                if hi > lo and new is None:
                    unit = _repeated(own[lo:hi], own[max(0, lo - (hi - lo)) : lo], own[hi : hi + hi - lo])
                    if unit is not None and "(" + " ".join(unit) + ")+" not in units and not (len(unit) == 1 and unit[0].endswith(")+")):
                        new = unit
            i, j = x + 1, y + 1
        if new is None:
            break
        units["(" + " ".join(new) + ")+"] = new
    out, labels = [], {(0, 0): 0}
    previous = (0, 0)
    fresh = 0

    def put(shape, body, label):
        nonlocal previous, fresh
        if label != previous and label != (0, 0):
            fresh += 1
            labels[label] = fresh
        previous = label
        out.append((shape, body, labels[label]))

    i = j = 0
    for x, y in pairs:
        for k in range(i, x):
            put(a[k][0], a[k][1], (a[k][2], "-"))
        for k in range(j, y):
            put(b[k][0], b[k][1], ("-", b[k][2]))
        if x < len(a):
            put(a[x][0], _join_bodies(a[x][1], b[y][1]), (a[x][2], b[y][2]))
        i, j = x + 1, y + 1
    return out


class Automaton:
    """The position automaton of a wrapper; sets of positions are bits of an integer."""

    def __init__(self, items: list):
        self.symbol: list[str] = []
        self.constant: list[str | None] = []
        self.follow: list[int] = []
        self.before: list[int] = []
        opts = [i[2] for i in items]
        parts, at = [], 0
        while at < len(items):
            end = at + 1
            if opts[at]:
                while end < len(items) and opts[end] == opts[at]:
                    end += 1
            part = self._sequence([self._item(i) for i in items[at:end]])
            parts.append((part[0], part[1], part[2] or bool(opts[at])))
            at = end
        self.first, self.last, self.empty = self._sequence(parts)
        self.tags: dict[str, int] = {}
        self.texts: dict[str, int] = {}
        self.slots = self.single = 0
        for p, (s, c) in enumerate(zip(self.symbol, self.constant)):
            if s != "T":
                self.tags[s] = self.tags.get(s, 0) | 1 << p
            elif c is None:
                self.slots |= 1 << p
            else:
                self.texts[c[1:]] = self.texts.get(c[1:], 0) | 1 << p
                self.single |= 1 << p if c[0] == ONE else 0
        for p, f in enumerate(self.follow):
            for q in self._bits(f):
                self.before[q] |= 1 << p
        self._next: dict[tuple[int, int], int] = {}
        self._reach: dict[int, int] = {}
        self.number = self._numbered()

    def _numbered(self) -> dict[int, int]:
        """Numbers of the positions whose texts are data: slots and what one page alone has;
        without any nothing tells data from template, and all texts are given."""
        data = self.slots | self.single or sum(1 << p for p, s in enumerate(self.symbol) if s == "T")
        return {p: k for k, p in enumerate(self._bits(data))}

    def confirm(self, met: int) -> None:
        """Constants at these positions have been met on a second page."""
        self.single &= ~met
        self.number = self._numbered()

    @staticmethod
    def _bits(x: int):
        while x:
            low = x & -x
            yield low.bit_length() - 1
            x ^= low

    def _item(self, item):
        shape, body, _ = item
        if isinstance(body, tuple):
            first, last, empty = self._sequence([self._item(i) for i in body])
            for p in self._bits(last):
                self.follow[p] |= first
            return first, last, empty
        p = len(self.symbol)
        self.symbol.append(shape)
        self.constant.append(body)
        self.follow.append(0)
        self.before.append(0)
        return 1 << p, 1 << p, False

    def _sequence(self, parts):
        first, last, empty = 0, 0, True
        for f, z, e in parts:
            for p in self._bits(last):
                self.follow[p] |= f
            first |= f if empty else 0
            last = z | (last if e else 0)
            empty = empty and e
        return first, last, empty

    def _allowed(self, symbol: str, text: str | None) -> int:
        return self.tags.get(symbol, 0) if symbol != "T" else self.slots | self.texts.get(text, 0)

    def run(self, stream) -> list[int] | None:
        """The set of possible positions after each token, or None."""
        out, now = [], -1
        for symbol, text in stream:
            allowed = self._allowed(symbol, text)
            if now == -1:
                now = self.first & allowed
            else:
                reach = self._reach.get(now)
                if reach is None:
                    reach = 0
                    for p in self._bits(now):
                        reach |= self.follow[p]
                    if len(self._reach) > 50_000:
                        self._reach.clear()
                    self._reach[now] = reach
                now = reach & allowed
            if not now:
                return None
            out.append(now)
        if out:
            return out if now & self.last else None
        return out if self.empty else None

    def positions(self, stream) -> list[int] | None:
        """A position for each token, constants before slots."""
        sets = self.run(stream)
        if not sets:
            return sets
        out, may = [0] * len(sets), self.last
        for k in range(len(sets) - 1, -1, -1):
            can = sets[k] & may
            can = can & ~self.slots or can
            out[k] = (can & -can).bit_length() - 1
            may = self.before[out[k]]
        return out


class Wrappers:
    """The wrappers of one host."""

    def __init__(self, lists: list[list] | None = None):
        self.items = [list(i) for i in lists or []]
        self._made: list[Automaton | None] = [None] * len(self.items)
        self._counts: list[Counter | None] = [None] * len(self.items)

    def automaton(self, k: int) -> Automaton:
        if self._made[k] is None:
            self._made[k] = Automaton(self.items[k])
        return self._made[k]

    @staticmethod
    def _tags(items) -> Counter:
        out: Counter = Counter()
        for shape, body, _ in items:
            if isinstance(body, tuple):
                out.update(set(Wrappers._tags(body)))
            elif shape != "T":
                out[shape] = 1
        return out

    def accepts(self, stream) -> int | None:
        for k in range(len(self.items)):
            if self.automaton(k).run(stream) is not None:
                return k
        return None

    def add(self, items: list) -> None:
        """Widen the wrapper most alike, or begin another."""
        mine = self._tags(items)
        best, like = None, LEAST_LIKE
        for k in range(len(self.items)):
            if self._counts[k] is None:
                self._counts[k] = self._tags(self.items[k])
            other = self._counts[k]
            share = len(mine.keys() & other.keys()) / max(1, min(len(mine), len(other)))
            if share >= like and (best is None or share > like):
                best, like = k, share
        if best is None:
            self.items.append(items)
            self._made.append(None)
            self._counts.append(mine)
        else:
            self.items[best] = merge(self.items[best], items)
            self._made[best] = self._counts[best] = None

    def learn(self, stream) -> None:
        k = self.accepts(stream)
        if k is None:
            self.add(page_items(stream))
        else:
            self._confirm(k, stream)

    def _confirm(self, k: int, stream) -> None:
        """Constants that only one page had, and that this one has too."""
        auto = self.automaton(k)
        if not auto.single or not any(auto.texts.get(t, 0) & auto.single for _, t in stream if t is not None):
            return
        met = sum({1 << p for p in auto.positions(stream)}) & auto.single
        if not met:
            return
        auto.confirm(met)
        numbers = count()

        def marked(items):
            out = []
            for shape, body, opt in items:
                if isinstance(body, tuple):
                    out.append((shape, tuple(marked(body)), opt))
                else:
                    out.append((shape, MANY + body[1:] if met >> next(numbers) & 1 else body, opt))
            return out

        self.items[k] = marked(self.items[k])

    def join(self, other: Wrappers) -> None:
        for items in other.items:
            self.add(items)

    def to_json(self) -> str:
        return json.dumps(self.items, separators=(",", ":"), ensure_ascii=False)

    @classmethod
    def from_json(cls, blob: str) -> Wrappers:
        def item(x):
            return (x[0], tuple(item(i) for i in x[1]) if isinstance(x[1], list) else x[1], x[2])

        return cls([[item(x) for x in one] for one in json.loads(blob)])

    def extract(self, stream) -> tuple[int, list[int], list[str]] | None:
        """Wrapper number, slot numbers and texts."""
        k = self.accepts(stream)
        if k is None:
            return None
        auto = self.automaton(k)
        slots, texts = [], []
        for (_, text), p in zip(stream, auto.positions(stream) or []):
            slot = auto.number.get(p)
            if slot is not None:
                slots.append(slot)
                texts.append(readable(text))
        return k, slots, texts


def _host(column: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def infer(pages: DataFrame) -> DataFrame:
    """(host, pages, wrappers): the wrappers of every host, as JSON."""
    spark = pages.sparkSession
    at = workdir(spark, "wrappers")
    ddl = "host string, pages bigint, wrappers string"

    def scan(batches):
        found: dict[str, Wrappers] = {}
        n_pages: Counter = Counter()
        for b in slices(batches, "html"):
            for host, page in zip(b["host"].to_pylist(), b["html"].to_pylist()):
                stream = tokens(page)
                if stream:
                    if host not in found:
                        found[host] = Wrappers()
                    found[host].learn(stream)
                    n_pages[host] += 1
        yield _batch(found, n_pages)

    def _batch(found, n_pages):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array([n_pages[h] for h in found], pa.int64()), pa.array([w.to_json() for w in found.values()], pa.string())],
            names=["host", "pages", "wrappers"],
        )

    def reduce(table: pa.Table) -> pa.Table:
        own = sorted(zip(table["pages"].to_pylist(), table["wrappers"].to_pylist()), reverse=True)
        first = Wrappers.from_json(own[0][1])
        for _, blob in own[1:]:
            first.join(Wrappers.from_json(blob))
        return pa.table({"host": table["host"].slice(0, 1), "pages": pa.array([sum(n for n, _ in own)], pa.int64()), "wrappers": pa.array([first.to_json()], pa.string())})

    source = pages.where("html IS NOT NULL").select(_host().alias("host"), "html")
    level = 0
    now = settle(source.mapInArrow(scan, ddl), f"{at}/0")
    while True:
        most = now.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return now
        level += 1
        groups = -(-most // FAN_IN)
        part = F.pmod(F.xxhash64("wrappers"), F.lit(groups))
        now = settle(now.withColumn("part", part).groupBy("host", "part").applyInArrow(lambda t: reduce(t.select(["host", "pages", "wrappers"])), ddl), f"{at}/{level}")
        remove(spark, f"{at}/{level - 1}")


def extract(pages: DataFrame, wrappers: DataFrame, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(page_id, host, wrapper, text, slots): what is in the slots of a page's wrapper, one
    line each, and the number of each line's slot."""
    kind = pages.schema["page_id"].dataType
    arrow = to_arrow_type(kind)
    ddl = f"page_id {kind.simpleString()}, host string, wrapper int, text string, slots array<int>"

    def rows(batches, find):
        for b in slices(batches, "html"):
            out = ([], [], [], [])
            for n, (host, page) in enumerate(zip(b["host"].to_pylist(), b["html"].to_pylist())):
                got = None
                if page is not None:
                    stream = tokens(page)
                    known = find(b, n, host) if stream else None
                    got = known.extract(stream) if known else (None, [], [])
                k, slots, texts = got or (None, None, None)
                for column, value in zip(out, (host, k, None if texts is None else "\n".join(texts), slots)):
                    column.append(value)
            types = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b["page_id"].cast(arrow), *[pa.array(c, t) for c, t in zip(out, types)]], names=["page_id", "host", "wrapper", "text", "slots"])

    source = pages.select("page_id", _host().alias("host"), "html")
    size = wrappers.agg(F.sum(F.octet_length("wrappers"))).first()[0] or 0
    if size <= broadcast_limit:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrappers"] for r in wrappers.select("host", "wrappers").collect()})

        def scan(batches):
            made: dict[str, Wrappers | None] = {}

            def find(_, __, host):
                if host not in made:
                    blob = shared.value.get(host)
                    made[host] = Wrappers.from_json(blob) if blob else None
                return made[host]

            yield from rows(batches, find)

        return source.mapInArrow(scan, ddl)

    def joined(batches):
        last = {}

        def find(b, n, host):
            if host not in last:
                if len(last) >= 256:
                    last.clear()
                blob = b["wrappers"][n].as_py()
                last[host] = Wrappers.from_json(blob) if blob else None
            return last[host]

        yield from rows(batches, find)

    both = source.join(wrappers.select(F.col("host").alias("__gf_host"), "wrappers"), F.col("host") == F.col("__gf_host"), "left")
    return both.select("page_id", "host", "html", "wrappers").mapInArrow(joined, ddl)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, infer(pages))
