"""Main text of web pages: a template deduced from same-host pages, and what fills its slots.

Each page is cut into tokens once; what later steps need of them is a written table of token ids,
flags and texts.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowsift.llm.common import by_value, on_batches, stored, text_batches

#: a host with fewer pages is read with the template of all pages
LEAST_PAGES = 4
SALTS = 32
#: templates of more hosts, or of more characters, are joined and not broadcast
MOST_HOSTS = 20_000
MOST_BYTES = 16_000_000
#: different tags that a task remembers
TAGS = 50_000

# HTML's element names and common names of page parts.
RAW = "script style noscript iframe textarea".split()  # up to the end tag, or the page's end without one
HIDDEN = set("template object canvas select svg math".split())  # left out if there is an end tag
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
MAIN = {"article", "main"}
ASIDE = set("aside button dialog footer form head menu nav title".split())
ASIDE_ROLES = set("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
#: elements that may be page parts, and words of classes and ids that say so; the last few outside of the article only
PARTS = set("article aside center details div dl fieldset footer form header main menu nav ol section table ul".split())
ASIDE_WORDS = set("ad ads advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus login menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
OUTER_WORDS = set("footer header masthead".split())

# A value is quoted only right behind its "="; a quote elsewhere, as in title=don't, is a sign like any other.
INSIDE_TAG = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+"
TOKEN = re.compile(
    r"(?P<text>[^<]++)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])" + INSIDE_TAG + r">.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|(?P<tag></?[a-zA-Z][a-zA-Z0-9:-]*+" + INSIDE_TAG + r">)|<[!?/][^>]*>|(?P<stray><)",
    re.S | re.I,
)
TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)(.*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
DIGITS = re.compile(r"\d+")
LETTERS = re.compile(r"[a-z]+")

# Bits of a token: a text; beside the article; in an article or main element; in a link; a block begins
# or ends here; words on both sides are apart.
TEXT, BESIDE, INSIDE, LINKED, BREAK, SPACE = (1 << k for k in range(6))
# Bits of an element: beside by its name or role; a form; a header; article or main; html or body;
# page part by a whole word of class or id, or by a word within one; the same outside of the article only.
NAMED, FORM, HEADER, HOLDER, PAGE, WORD, PART_WORD, OUTER, PART_OUTER = (1 << k for k in range(9))


def tag_parts(tag: str) -> tuple[str, str, dict[str, str], str]:
    """``(kind, name, attributes, token)`` of a tag, which is open, void or end.

    Two tags are the same token if names and class, id and role agree but for digits.
    """
    name, rest = TAG.match(tag).groups()
    name = name.lower()
    if tag[1] == "/":
        return "end", name, {}, f"</{name}>"
    found: dict[str, str] = {}
    if "=" in rest:
        for key, *values in ATTRIBUTE.findall(rest):
            if key.lower() in ("class", "id", "role"):
                found.setdefault(key.lower(), "".join(values))
    label = " ".join(f"{k}={DIGITS.sub('#', v)}" for k, v in sorted(found.items()))
    return "void" if name in VOID or rest.endswith("/") else "open", name, found, f"<{name} {label}>"


def tokens(html: str):
    """``(kind, name, attributes, token)``: tags as open, void or end, and texts; the rest is left out.

    Two texts are the same token if they agree but for white space; of one, ``attributes`` has the
    text as it is. A text of white space has an empty token.
    """
    for m in TOKEN.finditer(html):
        if m.lastgroup == "tag":
            yield tag_parts(m[0])
        elif m.lastgroup in ("text", "stray"):
            yield "text", "", m[0], " ".join(m[0].split())


def token_id(token: str) -> int:
    h = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def traits(name: str, attributes: dict[str, str]) -> int:
    """What name, role, class and id of an element say."""
    bits = NAMED * (name in ASIDE) | FORM * (name == "form") | HEADER * (name == "header") | HOLDER * (name in MAIN) | PAGE * (name in ("html", "body"))
    if attributes.get("role", "").lower() in ASIDE_ROLES:
        bits |= NAMED
    if name in PARTS and (attributes.get("class") or attributes.get("id")):
        label = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
        whole, parts = set(label.split()), set(LETTERS.findall(label))
        bits |= WORD * bool(whole & ASIDE_WORDS) | PART_WORD * bool(parts & ASIDE_WORDS)
        bits |= OUTER * bool(whole & OUTER_WORDS) | PART_OUTER * bool(parts & OUTER_WORDS)
    return bits


class Tags(dict):
    """``(kind, name, id, bits, traits or None)`` of tags, each worked out once; None where it begins no element of its own."""

    def __missing__(self, tag: str) -> tuple:
        kind, name, attributes, token = tag_parts(tag)
        own = traits(name, attributes)
        element = name in BLOCKS or name in HIDDEN or bool(own & NAMED)
        bits = BREAK if name in BLOCKS else SPACE if name == "br" or kind == "void" else 0
        if len(self) >= TAGS:
            self.clear()
        self[tag] = kind, name, token_id(token), bits, own if element else None
        return self[tag]


def parse(html: str, tags: Tags) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``(ids, flags, texts)``: id and bits of every token, and the texts among them, empty if beside the article.

    A text of white space has id 0.

    The article is the article and main elements below the fewest elements that class or id call
    a page part, so that of a post's comments or of a list of related posts isn't one; if even
    these are below such, only where they hold half of the text. Classes and ids say nothing of an
    element that is or holds the article, nor do they empty a page; without article, a word within a
    longer name doesn't leave out what holds most of the text either.
    """
    ids: list[int] = []
    flags: list[int] = []
    texts: list[str] = []
    owner: list[int] = []
    parent, bits, mass, names = [-1], [0], [0], [""]
    stack, opened, linked = [0], Counter(), 0
    found = [(m.lastgroup, m[0]) for m in TOKEN.finditer(html) if m.lastgroup in ("tag", "text", "stray")]
    last_end = {}
    for at, (group, token) in enumerate(found):
        if group == "tag" and token[1] == "/":
            last_end[tags[token][1]] = at
    for at, (group, token) in enumerate(found):
        if group != "tag":
            bare = " ".join(token.split())
            ids.append(token_id(bare) if bare else 0)
            flags.append(TEXT | linked)
            owner.append(stack[-1])
            texts.append(token)
            if not linked:
                mass[stack[-1]] += len(bare)
            continue
        kind, name, key, own, element = tags[token]
        if name == "a":
            linked = 0 if kind == "end" else LINKED
        if kind == "open" and element is not None:
            if name in BLOCKS and names[stack[-1]] == "p":
                opened[names[stack.pop()]] -= 1  # a paragraph ends where a block begins
            if name not in HIDDEN or last_end.get(name, -1) > at:
                parent.append(stack[-1])
                bits.append(element | NAMED * (name in HIDDEN))
                mass.append(0)
                names.append(name)
                stack.append(len(parent) - 1)
                opened[name] += 1
        ids.append(key)
        flags.append(own)
        owner.append(stack[-1])
        if kind == "end" and opened[name]:
            while True:
                closed = names[stack.pop()]
                opened[closed] -= 1
                if closed == name:
                    break
    own_mass = list(mass)
    for k in range(len(parent) - 1, 0, -1):
        mass[parent[k]] += mass[k]
    element_bits = _sides(parent, bits, mass)
    shown = [m for m, e in zip(own_mass, element_bits) if not e & BESIDE]
    if mass[0] and not any(shown):  # not by words alone
        element_bits = _sides(parent, [b & ~(WORD | PART_WORD | OUTER | PART_OUTER) for b in bits], mass)
    bits_of = np.array(flags, np.uint8) | np.array(element_bits, np.uint8)[np.array(owner, np.int64)]
    beside = (bits_of[bits_of & TEXT > 0] & BESIDE > 0).tolist()
    return np.array(ids, np.int64), bits_of, ["" if b else t for t, b in zip(texts, beside)]


def _sides(parent: list[int], bits: list[int], mass: list[int]) -> list[int]:
    """Per element whether it is beside the article, and inside."""
    words = WORD | PART_WORD | OUTER | PART_OUTER
    marks, named, candidates = [0], [False], []
    for k in range(1, len(parent)):
        own = bits[k]
        marks.append(marks[parent[k]] + (bool(own & words) and not own & PAGE))
        named.append(named[parent[k]] or bool(own & NAMED and not own & FORM))
        if own & HOLDER and not named[k]:
            candidates.append(k)
    fewest = min((marks[k] for k in candidates), default=0)
    mains = {k for k in candidates if marks[k] == fewest}
    if fewest:
        outermost, held = set(), 0
        for k in sorted(mains):  # a main element's children come behind it
            up = parent[k]
            while up > 0 and up not in outermost:
                up = parent[up]
            if up <= 0:
                outermost.add(k)
                held += mass[k]
        if 2 * held < mass[0]:
            mains = set()
    holds = set()
    for k in mains:
        while k > 0 and k not in holds:
            holds.add(k)
            k = parent[k]
    sides = [0]
    for k in range(1, len(parent)):
        own, side = bits[k], sides[parent[k]]
        if k in mains and not side & BESIDE:
            side |= INSIDE
        inside = side & INSIDE
        if own & NAMED:
            beside = not (own & FORM and k in holds)
        elif own & HEADER and not inside:
            beside = True
        elif k in holds or own & PAGE:
            beside = False
        elif own & WORD or not inside and own & OUTER:
            beside = True
        else:
            beside = (own & PART_WORD or not inside and own & PART_OUTER) and not (not mains and 2 * mass[k] > mass[0])
        sides.append(side | BESIDE if beside else side)
    return sides


def parsed(pages: DataFrame) -> DataFrame:
    """``(page_id, url, host, page, ids, flags, texts)``: each page's tokens, read once."""

    def make(batch):
        tags = Tags()
        for first, htmls in text_batches(batch, "html"):
            made = [parse(h, tags) for h in htmls]
            own = batch.slice(first, len(htmls))
            columns = [own.column(c) for c in ("page_id", "url", "host", "page")]
            columns += [pa.array([m[k].tobytes() for m in made], pa.binary()) for k in (0, 1)] + [pa.array([m[2] for m in made], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "page", "ids", "flags", "texts"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(on_batches(make), f"page_id {kind}, url string, host string, page long, ids binary, flags binary, texts array<string>")


def _arrays(column: pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), kind) for v in column]


def occurrences(read: DataFrame) -> DataFrame:
    """``(host, page, token, n, first, tag)``: how often each token occurs in each page, and where first; token 0 is the page itself."""

    def make(batch):
        ids = _arrays(batch.column("ids"), np.int64)
        sizes = np.array([len(i) for i in ids])
        page = np.repeat(np.arange(len(ids)), sizes)
        at = np.arange(len(page)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = np.concatenate(ids)
        text = np.concatenate(_arrays(batch.column("flags"), np.uint8)) & TEXT
        some = np.flatnonzero(key)
        page, at, key, text = (np.concatenate([a[some], b]) for a, b in ((page, np.arange(len(ids))), (at, np.zeros(len(ids), np.int64)), (key, np.zeros(len(ids), np.int64)), (text, np.full(len(ids), TEXT, np.uint8))))
        order = np.lexsort((at, key, page))
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(page[order]) != 0) | (np.diff(key[order]) != 0)]))
        one = order[begins]
        n = np.diff(np.append(begins, len(order)))
        owners = batch.select(["host", "page"]).take(pa.array(page[one]))
        columns = [*owners.columns, pa.array(key[one]), pa.array(n.astype(np.int32)), pa.array(at[one]), pa.array(text[one] == 0)]
        yield pa.RecordBatch.from_arrays(columns, ["host", "page", "token", "n", "first", "tag"])

    return read.select("host", "page", "ids", "flags").mapInArrow(on_batches(make), "host string, page long, token long, n int, first long, tag boolean")


def _candidates(vectors: DataFrame) -> DataFrame:
    """``(host, classes)``: token classes of each host, the most frequent first, ``(-pages, vector, (place, token))``.

    Tokens of one occurrence vector are a class. It is a candidate if it has several tokens, a tag
    among them, and is on at least half of the pages. ``place`` sums up where a token is first: as
    tokens of a class are on the same pages, an ordered class has its order by it.
    """
    pages = vectors.where("token = 0").select("host", F.col("pages").alias("all"))
    classes = vectors.where("token != 0").groupBy("host", "vector", "pages").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("members"), F.max("tag").alias("tag"))
    classes = classes.join(pages, "host").where(f"all >= {LEAST_PAGES} and 2 * pages >= all and tag and size(members) > 1")
    return classes.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("less"), "vector", "members"))).alias("classes"))


def out_of_order(places: list[int]) -> list[int]:
    """Indexes outside of a longest increasing run of ``places``."""
    ends, tails, before = [], [], []
    for i, place in enumerate(places):
        k = bisect_left(ends, place)
        before.append(tails[k - 1] if k else -1)
        ends[k : k + 1], tails[k : k + 1] = [place], [i]
    kept, i = set(), tails[-1] if tails else -1
    while i >= 0:
        kept.add(i)
        i = before[i]
    return [i for i in range(len(places)) if i not in kept]


class Classes:
    """Candidate classes of a host, and what its pages say of them, token by token."""

    def __init__(self, classes: list[dict]):
        self.members = [[m["token"] for m in c["members"]] for c in classes]
        self.of = {t: c for c, members in enumerate(self.members) for t in members}
        self.tokens = np.sort(np.array(list(self.of), np.int64))
        self.unordered: set[int] = set()
        self.crossing: set[int] = set()
        self.around: dict[int, set[int]] = {}

    def only(self, ids: np.ndarray) -> list[int]:
        """The class tokens among a page's, in their order."""
        return ids[in_template(ids, self.tokens)].tolist()

    def read(self, ids: list[int]) -> None:
        """Checks the classes on a page, given the ids of its tokens in their order."""
        at: dict[int, list[int]] = {}
        for i, key in enumerate(ids):
            if key in self.of:
                at.setdefault(key, []).append(i)
        line: list[tuple[int, int, int, int]] = []  # (place, class, index, token)
        last = {}
        for c, members in enumerate(self.members):
            here = [t for t in members if t in at]
            times = min((len(at[t]) for t in here), default=0)
            wrong = out_of_order([at[t][k] for k in range(times) for t in here])
            wrong = {here[i % len(here)] for i in wrong}
            self.unordered |= wrong
            here = [t for t in here if t not in wrong]
            last[c] = len(here) - 1
            line += [(at[t][k], c, j, t) for k in range(times) for j, t in enumerate(here)]
        crossing: set[int] = set()
        stack: list[tuple[int, int]] = []  # (class, slot)
        for _, c, j, token in sorted(line):
            if c in crossing:
                continue
            if not j:
                self.around.setdefault(c, set()).add(stack[-1][1] if stack else 0)
            else:
                while stack[-1][0] > c:  # a class of fewer pages gives way
                    crossing.add(stack.pop()[0])
                if stack[-1][0] != c:
                    crossing.add(c)
                    stack = [x for x in stack if x[0] != c]
                    continue
                stack.pop()
            if j < last[c]:
                stack.append((c, token))
        self.crossing |= crossing

    def rows(self, host):
        for t, c in self.of.items():
            around = self.around.get(c) or {None}
            yield host, t, c, t in self.unordered, c in self.crossing or len(around) > 1, next(iter(around))


READ = "host string, token long, class int, unordered boolean, crossing boolean, around long"
SUMS = "host string, token long, text long, link long"


def decide(rows: list[dict]) -> list[int]:
    """Template tokens of a host.

    Left out are tokens that break the order of their class, and classes that cross one before them,
    are not always in the same slot of another or have a single token left.
    """
    left = Counter(r["class"] for r in rows if not r["unordered"])
    return [r["token"] for r in rows if not r["unordered"] and not r["crossing"] and left[r["class"]] > 1]


def _with(rows: DataFrame, table: DataFrame, column: str, make, schema: str) -> DataFrame:
    """``make(batch, of)`` on all rows; ``of(row)`` is what ``table`` has for the row's host, or None.

    A table proven small is broadcast. Otherwise pages meet it by host and salt, so a host with most
    of the pages is spread over tasks.
    """
    hosts, size = table.agg(F.count("*"), F.sum(F.length(F.to_json(column)))).first()
    if hosts <= MOST_HOSTS and (size or 0) <= MOST_BYTES:
        shared = rows.sparkSession.sparkContext.broadcast({r["host"]: r[column] for r in table.toArrow().to_pylist()})

        def simple(batch):
            names, all_ = batch.column("host").to_pylist(), shared.value
            return make(batch, lambda row: all_.get(names[row]))

        return rows.mapInArrow(on_batches(simple), schema)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def met(batch):
        names, values, known = batch.column("host").to_pylist(), batch.column(column), {}

        def of(row):
            if names[row] not in known:
                known[names[row]] = values[row].as_py()
            return known[names[row]]

        return make(batch, of)

    return joined.drop("salt").mapInArrow(on_batches(met), schema)


def _read(rows: DataFrame, classes: DataFrame, everyone: list[dict] | None) -> DataFrame:
    """What pages say of the classes of their host, and of those of all pages, as host ''."""

    def make(batch, of):
        hosts, found = batch.column("host").to_pylist(), {}
        for row, ids in enumerate(_arrays(batch.column("ids"), np.int64)):
            name = hosts[row]
            if name not in found:
                found[name] = Classes(own) if (own := of(row)) is not None else None
            if "" not in found:
                found[""] = Classes(everyone) if everyone else None
            for group in (found[name], found[""]):
                if group is not None:
                    group.read(group.only(ids))
        types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64()]
        columns = list(zip(*(r for name, c in found.items() if c is not None for r in c.rows(name)))) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in READ.split(", ")])

    return _with(rows.select("host", "page", "ids"), classes, "classes", make, READ)


def in_template(ids: np.ndarray, template: np.ndarray) -> np.ndarray:
    if not len(template):
        return np.zeros(len(ids), bool)
    return template[np.minimum(np.searchsorted(template, ids), len(template) - 1)] == ids


def slots(ids: np.ndarray, flags: np.ndarray, template: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(texts, slot, mine)``: places of the texts; the template token before each, or 0; whether it may be the article's.

    A text beside the article isn't, nor one of white space, nor one outside of it that the template holds.
    """
    held = in_template(ids, template)
    last = np.maximum.accumulate(np.where(held, np.arange(len(ids)), -1)) if len(ids) else np.zeros(0, np.int64)
    at = np.flatnonzero(flags & TEXT)
    slot = np.where(last[at] >= 0, ids[last[at]], 0)
    mine = (ids[at] != 0) & (flags[at] & BESIDE == 0) & ((flags[at] & INSIDE > 0) | ~held[at])
    return at, slot, mine


def _weighed(rows: DataFrame, own: DataFrame, everyone: list[int]) -> DataFrame:
    """``(host, found)``: the template and the tokens whose slots are lists of links.

    A slot is such a list if most of its text on all pages is links and another slot holds more text.
    """
    common = np.sort(np.array(everyone, np.int64))

    def make(batch, of):
        hosts, made, sums = batch.column("host").to_pylist(), {"": common}, {}
        ids, flags = _arrays(batch.column("ids"), np.int64), _arrays(batch.column("flags"), np.uint8)
        for row, sizes in enumerate(batch.column("sizes")):
            name, size = hosts[row], np.asarray(sizes.values)
            if name not in made:
                made[name] = np.sort(np.array(of(row) or (), np.int64))
            for host in (name, ""):
                if len(made[host]):
                    at, slot, mine = slots(ids[row], flags[row], made[host])
                    link = (flags[row][at] & LINKED > 0) * size
                    held = sums.setdefault(host, {})
                    for key in np.unique(slot[mine]).tolist():
                        here = mine & (slot == key)
                        total = held.setdefault(key, [0, 0])
                        total[0] += int(size[here].sum())
                        total[1] += int(link[here].sum())
        columns = list(zip(*((name, t, *x) for name, found in sums.items() for t, x in found.items()))) or [()] * 4
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["host", "token", "text", "link"])

    narrow = rows.select("host", "page", "ids", "flags", F.transform("texts", F.length).alias("sizes"))
    weights = _with(narrow, own, "template", make, SUMS).groupBy("host", "token").agg(F.sum("text").alias("text"), F.sum("link").alias("link"))
    weights = weights.groupBy("host").agg(F.max("text").alias("most"), F.collect_list(F.struct("token", "text", "link")).alias("slots"))
    links = F.expr("transform(filter(slots, s -> s.token != 0 and 2 * s.link > s.text and s.text < most), s -> s.token)")
    every = own.sparkSession.createDataFrame([("", everyone)], "host string, template array<long>")
    joined = own.union(every).join(weights.select("host", links.alias("links")), "host", "left")
    none = F.array().cast("array<bigint>")
    return stored(joined.select("host", F.struct("template", F.coalesce("links", none).alias("links")).alias("found")), "templates")


def templates(read: DataFrame) -> tuple[DataFrame, tuple[list[int], list[int]]]:
    """``(host, found)`` with the template of each host, and that of all pages taken together.

    An occurrence vector is known by the exclusive or of a hash of page and count, which is combined
    before the shuffle: a host with most of the pages costs each task a row per token. Half of the
    pages hold each token, so a template is at most twice as long as a page on average. Token ids are
    read again to check order and nesting of the classes, and once more for the texts of their slots;
    both times each page serves its host's template and that of all pages.
    """
    found = occurrences(read)
    by_host = found.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.max("tag").alias("tag"), F.sum("first").alias("place")
    )
    by_host = stored(by_host, "tokens")
    whole = by_host.groupBy("token").agg(F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.max("tag").alias("tag"), F.sum("place").alias("place"))
    classes = stored(_candidates(by_host.where("host is not null")).unionByName(_candidates(whole.withColumn("host", F.lit("")))), "classes")
    every = classes.where("host = ''").first()
    checked = _read(read, classes.where("host != ''"), every.asDict(recursive=True)["classes"] if every else None)
    checked = checked.groupBy("host", "token", "class").agg(
        F.max("unordered").alias("unordered"), F.expr("max(crossing) or coalesce(min(around) != max(around), false)").alias("crossing")
    )
    checked = checked.groupBy("host").agg(F.collect_list(F.struct("token", "class", "unordered", "crossing")).alias("rows"))

    def make(batch):
        made = [decide(r.as_py()) for r in batch.column("rows")]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, pa.list_(pa.int64()))], ["host", "template"])

    own = stored(checked.mapInArrow(on_batches(make), "host string, template array<long>").where("size(template) > 0"), "templates")
    every = own.where("host = ''").first()
    weighed = _weighed(read, own.where("host != ''"), list(every.template) if every else [])
    common = weighed.where("host = ''").first()
    return weighed.where("host != ''"), (list(common.found.template), list(common.found.links))


def assembled(ids: np.ndarray, flags: np.ndarray, texts: list[str], template: np.ndarray, links: np.ndarray) -> str:
    """Blocks of the slots that hold the article, one to a line.

    Slots lie between template tokens, outside of elements beside the article. ``links`` are the
    tokens whose slots are lists of links on the host's pages; those are left out, in article
    elements too. Where the page has an article or main element, its slots are the article, with the
    texts that the template holds; else every slot is, without them.
    """
    at, slot, mine = slots(ids, flags, template)
    kept = mine & ~in_template(slot, links)
    block = np.cumsum(flags & BREAK > 0)[at]
    apart = np.diff(np.cumsum(flags & SPACE > 0)[at], prepend=0) > 0
    inside = flags[at] & INSIDE > 0
    blocks: list[tuple[bool, str]] = []
    now: list[str] = []
    here, within = -1, False

    def flush() -> None:
        text = " ".join(references.unescape("".join(now)).split())
        now.clear()
        if text:
            blocks.append((within, text))

    for text, number, space, keep, main in zip(texts, block.tolist(), apart.tolist(), kept.tolist(), inside.tolist()):
        if number != here:
            flush()
            here = number
        if space or not keep:
            now.append(" ")  # words around white space and around what is left out stay apart
        if keep:
            now.append(text)
            within = main
    flush()
    return "\n".join(t for m, t in blocks if m) or "\n".join(t for _, t in blocks)


def main_text(html: str, template: set[int] | frozenset[int] = frozenset(), links: set[int] | frozenset[int] = frozenset()) -> str:
    """The article of one page, given its host's template and lists of links."""
    return assembled(*parse(html, Tags()), *(np.array(sorted(x), np.int64) for x in (template, links)))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row.

    The host is the authority of the url in lower case; a null url or one without is of no host, and
    like hosts of few pages read with the template of all pages. Null and empty pages have an empty
    text. Rows that are alike are pages of their own. No rows give no rows.
    """
    host = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"),
        F.when(F.length(host) > 0, host).alias("host"), F.xxhash64(id_col, url, html).alias("page"),
    )
    read = stored(parsed(rows), "parsed", "zstd")
    own, common = templates(read)

    def make(batch, of):
        everyone, made = tuple(np.sort(np.array(x, np.int64)) for x in common), {}
        hosts, texts = batch.column("host").to_pylist(), []
        columns = zip(_arrays(batch.column("ids"), np.int64), _arrays(batch.column("flags"), np.uint8), batch.column("texts"))
        for row, (ids, flags, parts) in enumerate(columns):
            name = hosts[row]
            if name not in made:
                got = of(row)
                made[name] = tuple(np.sort(np.array(got[c], np.int64)) for c in ("template", "links")) if got else everyone
            texts.append(assembled(ids, flags, parts.as_py(), *made[name]))
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return _with(read, own, "found", make, f"page_id {kind}, url string, text string, n_chars long")


by_value(__name__)
