"""Main text of web pages by template deduction over equivalence classes.

Pages of one host are dealt into groups of bounded size, and hosts of few pages share
a group, where pages of one layout learn from each other.  A page is a sequence of
tokens: tags, blocks of text, and the words of short blocks.  Tokens that share an
occurrence vector over the pages form an equivalence class; classes that occur once in
every page, in one order, are the template, and other classes nest in its slots (Arasu and
Garcia-Molina, "Extracting structured data from web pages", 2003).

Tags get their roles from the classes, element by element from the root (``roles``): an
element that occurs once in its parent on all pages is of the class of ones; siblings
with one label are told apart by what of that class they hold, or else by the slot of the
class in which they stand and, where a slot has as many on every page, by their place
in it; what is left repeats, and is content.  So a menu and an article that are both a
bare ``div`` have different roles, because their neighbours and contents do.

What the template leaves open fills its slots.  The article's slot is found by how
the open text is spread over the template's elements in all pages of the group: from
the root, the slot is narrowed to the element that holds most of it, whatever its
name.  A class is template only if it rests on ``SUPPORT`` different pages or more;
near copies of a page count once, for they agree in most blocks of the article.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import arrow, cut, table

#: Pages that one group is meant to hold.
GROUP = 64
#: The least different pages that a class or a label rests on (the method's support threshold).
SUPPORT = 3
#: Share of the open text at which a slot is narrowed to one of its elements.
MOST = 0.5
#: Blocks of up to so many words also count by their words.
SHORT = 8
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|button|canvas|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_BLOCKS = set("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tr td th blockquote pre section article main header footer nav aside form fieldset figure figcaption address hr br body html head title".split())
#: Elements that make a path; all others are often left open and only mark up text.
_STRUCTURE = set("html head body div section article main header footer nav aside form fieldset ul ol table dl figure menu dialog details".split())
#: Elements that the slot may be narrowed to; lists and tables are part of a text.
_NARROW = set("html body div section article main header".split())
#: Elements whose path starts anew.
_LANDMARKS = {"article", "main"}
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_PROSE = _HEADINGS | {"p", "blockquote", "pre"}
_PARAGRAPHS = set("p li blockquote pre td address".split())
_VOID = set("br hr img input meta link source area base col embed track wbr".split())
#: Elements that by the meaning of HTML aren't the text of the article that they stand in.
_ASIDE = set("head nav footer aside form fieldset menu dialog".split())
#: Labels of reader comments and adverts within an article, which differ from page to page as its text does.
_FOREIGN = set("comment comments disqus ad ads advert adverts advertisement advertising sponsored".split())
#: Labels of notices and the like; used only for pages of which a group has less than SUPPORT, so that no text can be told to be the same on all.
_UNPROVEN = set("share sharing social subscribe newsletter notice notices cookie cookies consent promo banner sidebar".split())
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPACE = re.compile(r"\s+")


def _label(tag: str, attrs: str) -> str:
    """Tag with its class, id and role; numbers in these, which often are the page's, are left out."""
    if not attrs or "=" not in attrs:
        return tag
    marks = {re.sub(r"[0-9]+", "#", w) for m in _CLASS.findall(attrs) for w in m.strip("\"'").lower().replace("/", "-").split()}
    return ".".join([tag, *sorted(marks)])


def _marks(label: str) -> set[str]:
    return {w for part in label.split(".")[1:] for w in re.split(r"[^a-z]+", part)}


@dataclass(frozen=True, slots=True)
class Token:
    """A tag ("<nav>", "</nav>") or a block of text at a labelled path; ``of`` is the label of the block's own element."""

    path: str
    text: str
    of: str = ""
    tag: bool = False


def parse(page: str | None) -> list[Token]:
    """Tokens of a page; scripts, styles and comments have none."""
    out: list[Token] = []
    stack: list[tuple[str, str]] = [("", "")]  # tag, path
    held: list[str] = []
    own = ""

    def end_block():
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            held.clear()
            if text:
                out.append(Token(stack[-1][1], text, own))

    page, at = page or "", 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(_html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in _BLOCKS:
            end_block()
            if tag != "br":
                own = _label(tag, m[4]) if not m[2] and (tag in _PARAGRAPHS or tag in _HEADINGS) else ""
        if tag not in _STRUCTURE:
            continue
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            out.append(Token(stack[-1][1], f"</{tag}>", tag=True))
        else:
            up = stack[-1][1]
            if tag in _LANDMARKS and not any(t in _LANDMARKS for t, _ in stack):
                up = ""  # what was left open before it doesn't hold it
            path = f"{up}/{_label(tag, m[4])}"
            out.append(Token(path, f"<{tag}>", tag=True))
            if tag not in _VOID and not (m[4] or "").endswith("/"):
                stack.append((tag, path))
    if at < len(page):
        held.append(_html.unescape(page[at:]))
    end_block()
    return out


@dataclass(eq=False, slots=True)
class _Node:
    """An element of a page: its label, children and text blocks' own elements in order, and its role path."""

    label: str
    children: list = field(default_factory=list)
    blocks: list = field(default_factory=list)
    #: How often each label occurs below, blocks' own elements included.
    below: Counter = field(default_factory=Counter)
    role: str = ""


def _tree(tokens: list[Token]) -> tuple[_Node, list[_Node]]:
    """The root of a page's elements, and the element of each token: its own for an opening tag, else that in which it stands."""
    root = _Node("")
    last, of = {"": root}, []
    for t in tokens:
        if t.tag and t.text[1] != "/":
            up, _, label = t.path.rpartition("/")
            node = _Node(label)
            last.get(up, root).children.append(node)
            last[t.path] = node
        elif not t.tag:
            last[t.path].blocks.append(t.of)
        of.append(last[t.path])

    order = [root]
    for node in order:
        order += node.children
    for node in reversed(order):
        node.below.update(x for x in node.blocks if x)
        for c in node.children:
            node.below.update(c.below)
            node.below[c.label] += 1
    return root, of


def _in_order(pages: list[list[str]]) -> list[str]:
    """Of names that occur once on every page, those that stand in one order on all, as they come on the first page."""
    once = set(pages[0]).intersection(*pages[1:])
    place = {x: i for i, x in enumerate(pages[0]) if x in once}
    for p in pages[1:]:
        top = -1
        for x in p:
            if x in place and place[x] < top:
                del place[x]
            elif x in place:
                top = place[x]
    return sorted(place, key=place.get)


def _named(parents: list[_Node]) -> None:
    """Gives the children of one element, which every page has once, their roles."""
    n = len(parents)
    ones = {x for x, k in parents[0].below.items() if k == 1}.intersection(*({x for x, k in q.below.items() if k == 1} for q in parents[1:]))
    held: dict[int, frozenset] = {}
    inside = [{x: frozenset(ones & c.below.keys()) for c in q.children for x in ones & c.below.keys()} for q in parents]
    steady = {x for x in ones if all(q.get(x) == inside[0].get(x) for q in inside)}  # together on all pages, or on none
    names: list[list[str]] = []
    for q in parents:
        single = Counter(c.label for c in q.children)
        own = []
        for c in q.children:
            marks = held[id(c)] = frozenset(steady & c.below.keys())
            own.append(c.label if single[c.label] == 1 and c.label in ones else f"{c.label}{{{'+'.join(sorted(marks))}}}" if marks else "")
        names.append(own)
    root = _in_order([[x for x in own if x] for own in names]) if n else []
    known = set(root)
    slots: list[Counter] = []
    for q, own in zip(parents, names, strict=True):
        at, count = 0, Counter()
        for i, c in enumerate(q.children):
            if own[i] in known:
                at = root.index(own[i]) + 1
            else:
                count[c.label, at] += 1
        slots.append(count)
    fixed = {k for k, v in slots[0].items() if all(o[k] == v for o in slots[1:])}
    for q, own in zip(parents, names, strict=True):
        at, count = 0, Counter()
        for i, c in enumerate(q.children):
            if own[i] in known:
                at, name = root.index(own[i]) + 1, own[i]
            else:
                count[c.label, at] += 1
                name = f"{c.label}@{at}" + (f"#{count[c.label, at]}" if (c.label, at) in fixed else "*")
            c.role = f"{q.role}/{name}"


def roles(pages: list[list[Token]]) -> list[list[Token]]:
    """The tokens with paths of roles instead of labels; the pages are those of one host or layout."""
    trees = [_tree(p) for p in pages]
    stack = [[root for root, _ in trees]] if trees else []
    while stack:
        parents = stack.pop()
        _named(parents)
        by: dict[str, list[_Node]] = defaultdict(list)
        for q in parents:
            for c in q.children:
                by[c.role].append(c)
        for role, nodes in by.items():
            if len(nodes) == len(parents) and role[-1] != "*":
                stack.append(nodes)
                continue
            for node in nodes:  # what repeats keeps its labels
                inner = [node]
                for x in inner:
                    for c in x.children:
                        c.role = f"{x.role}/{c.label}"
                    inner += x.children
    return [[Token(node.role, t.text, t.of, t.tag) for t, node in zip(p, of, strict=True)] for p, (_, of) in zip(pages, trees, strict=True)]


def _plain(role: str) -> str:
    """The label of a role."""
    return re.split(r"[{@]", role, maxsplit=1)[0]


def layout(tokens: list[Token]) -> frozenset:
    """The labels of a page's upper elements: what pages have in common that can learn from each other."""
    return frozenset(t.path for t in tokens if t.tag and t.text[1] != "/" and t.path.count("/") <= 3)


def told_apart(pages: list[list[Token]], hosts: list[str]) -> list[list[Token]]:
    """``roles`` of the pages of each host; pages of hosts of fewer than SUPPORT different pages go by layout, however few there are of one."""
    of: dict[object, list[int]] = defaultdict(list)
    for i, h in enumerate(hosts):
        of[h].append(i)
    sets: dict[object, list[int]] = {}
    for h, at in of.items():
        if len(different([pages[i] for i in at if pages[i]])) >= SUPPORT:
            sets[h] = [i for i in at if pages[i]]
        else:
            for i in at:
                if pages[i]:
                    sets.setdefault(layout(pages[i]), []).append(i)
    out = list(pages)
    for at in sets.values():
        for i, p in zip(at, roles([pages[i] for i in at]), strict=True):
            out[i] = p
    return out


def _atoms(tokens: list[Token]):
    """Tokens as the classes see them: (path, text) of tags and blocks, and of the words of short blocks that aren't prose."""
    for t in tokens:
        yield t.path, t.text
        if not t.tag and " " in t.text and t.of.split(".")[0] not in _PROSE:
            words = t.text.split(" ", SHORT)
            if len(words) <= SHORT:
                for w in words:
                    yield t.path, w


def template(pages: list[list[Token]]) -> tuple[list[tuple[str, str]], dict[int, list[tuple[str, str]]]]:
    """(root, nested): the ordered tokens that occur once in each page, and by slot the constant classes that nest there.

    The valid root class is the longest ordered beginning: tokens that don't stand in one order in all pages are left
    to the slots.  A slot's number is that of the root token before it.
    """
    vectors: dict[tuple[str, str], dict[int, int]] = defaultdict(dict)
    for i, p in enumerate(pages):
        for atom, n in Counter(_atoms(p)).items():
            vectors[atom][i] = n
    classes: dict[tuple, list[tuple[str, str]]] = defaultdict(list)
    for atom, v in vectors.items():
        if len(v) == len(pages):  # of full support; smaller classes are optional parts, hence slots
            classes[tuple(v[i] for i in range(len(pages)))].append(atom)
    once = set(classes.pop((1,) * len(pages), []))
    orders = [[a for a in _atoms(p) if a in once] for p in pages]
    rank = {a: i for i, a in enumerate(orders[0])} if orders else {}
    valid = set(once)
    for o in orders[1:]:
        top = -1
        for a in o:
            if a in valid:
                if rank[a] < top:
                    valid.discard(a)
                else:
                    top = rank[a]
    root = [a for a in (orders[0] if orders else []) if a in valid]
    number = {a: i for i, a in enumerate(root)}
    nested: dict[int, list[tuple[str, str]]] = defaultdict(list)
    constant = {a for v, atoms in classes.items() if len(set(v)) == 1 for a in atoms}
    slots: dict[tuple[str, str], set[int]] = defaultdict(set)
    for p in pages:
        at = -1
        for a in _atoms(p):
            at = number.get(a, at)
            if a in constant:
                slots[a].add(at)
    for a, s in slots.items():
        if len(s) == 1:
            nested[next(iter(s))].append(a)
    return root, dict(nested)


def _parents(path: str) -> list[str]:
    """``path`` and all paths above it, from the root on; the root is the empty path."""
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(1, len(parts) + 1)]


@dataclass
class Template:
    """What a group of pages has in common."""

    #: Blocks (path, text) that are part of the template, by host; "" holds for all.
    fixed: dict[str, set[tuple[str, str]]] = field(default_factory=dict)
    #: By element: open words in it, open words in what holds it, pages that have it, and pages with an open heading right in it.
    spread: dict[str, list[float]] = field(default_factory=lambda: defaultdict(lambda: [0.0, 0.0, 0.0, 0.0]))
    #: Pages on which an element or block of this label was seen within the article, and outside.
    inside: Counter = field(default_factory=Counter)
    outside: Counter = field(default_factory=Counter)
    #: Whether the group has too few pages to tell what is the same on all, so that the meaning of tags and labels counts.
    unproven: bool = False

    def main(self, tokens: list[Token]) -> str | None:
        """Path of the element that holds the article of a page; the root where the template tells nothing."""
        below: dict[str, dict[str, None]] = defaultdict(dict)
        for t in tokens:
            if t.tag and t.text[1] != "/":
                if self.unproven and _plain(t.path[1:]).split(".")[0] in _LANDMARKS:
                    return t.path
                below[t.path.rpartition("/")[0]][t.path] = None
        at = ""
        while True:
            own = self.spread.get(at)
            if own and own[2] and own[3] > MOST * own[2]:
                return at  # its heading is part of it
            share = lambda c: self.spread[c][0] / self.spread[c][1] if c in self.spread and self.spread[c][1] else 0.0
            best = max(below.get(at, ()), key=share, default=None)
            if best is None or share(best) <= MOST or best[-1] == "*" or _plain(best.rpartition("/")[2]).split(".")[0] not in _NARROW:
                return at
            at = best

    def foreign(self, label: str) -> bool:
        """Whether what bears this label isn't the article's, though it stands in it."""
        tag = label.split(".")[0]
        if tag in _ASIDE:
            return True
        if "." not in label:
            return False
        if self.outside[label] >= SUPPORT and not self.inside[label]:
            return True  # elements of this label are the template's
        return bool(_marks(label) & (_FOREIGN | _UNPROVEN if self.unproven else _FOREIGN))

    def blocks(self, tokens: list[Token], host: str = "") -> list[str]:
        """Blocks that fill the article's slot of a page; all blocks of it if the template tells nothing."""
        main = self.main(tokens)
        if not main and not self.unproven:
            return [t.text for t in tokens if not t.tag]
        common, own = self.fixed.get("", ()), self.fixed.get(host, ())
        drop: dict[str, bool] = {}

        def out(path: str) -> bool:
            found = drop.get(path)
            if found is None:
                up, _, label = path.rpartition("/")
                found = drop[path] = len(path) > len(main) and (self.foreign(_plain(label)) or out(up))
            return found

        got = []
        for t in tokens:
            if t.tag or not (t.path == main or t.path.startswith(main + "/")) or out(t.path) or t.of and self.foreign(t.of):
                continue
            if (t.path, t.text) not in common and (t.path, t.text) not in own:
                got.append(t.text)
        return got


def _classes(pages: list[list[Token]]) -> set[tuple[str, str]]:
    """Blocks of the template of these pages."""
    root, nested = template(pages)
    fixed = {*root, *(a for atoms in nested.values() for a in atoms)}
    return fixed & {(t.path, t.text) for t in pages[0] if not t.tag}


def different(pages: list[list[Token]]) -> list[list[Token]]:
    """Pages without copies and near copies: those that share over half of their long blocks with one that is kept."""
    kept: list[list[Token]] = []
    where: dict[object, list[int]] = defaultdict(list)
    for p in pages:
        keys: set = {t.text for t in p if not t.tag and t.text.count(" ") >= SHORT} or {tuple(t.text for t in p)}
        shared = Counter(i for k in keys for i in where.get(k, ()))
        if shared and 2 * max(shared.values()) > len(keys):
            continue
        for k in keys:
            where[k].append(len(kept))
        kept.append(p)
    return kept


def deduce(pages: list[list[Token]], hosts: list[str]) -> Template:
    """The template of a group.  Copies and near copies of a page on a host count once, for what they share is text."""
    of: dict[str, list[list[Token]]] = defaultdict(list)
    for p, h in zip(pages, hosts, strict=True):
        if p:
            of[h].append(p)
    by_host = {h: different(v) for h, v in of.items()}
    all_ = different([p for v in by_host.values() for p in v])
    out = Template(unproven=len(all_) < SUPPORT)
    if not out.unproven:
        out.fixed = {h: _classes(v) for h, v in by_host.items() if len(v) >= SUPPORT}
        if len(by_host) > 1:
            out.fixed[""] = _classes(all_)
    for h, pages_ in by_host.items():
        fixed = out.fixed.get(h, set()) | out.fixed.get("", set())
        for p in pages_:
            words: Counter = Counter()
            heads, paths = set(), {up for t in p for up in _parents(t.path)}
            for t in p:
                if not t.tag and (t.path, t.text) not in fixed:
                    n = t.text.count(" ") + 1
                    for up in _parents(t.path):
                        words[up] += n
                    if t.of.split(".")[0] in _HEADINGS:
                        heads.add(t.path)
            for path in paths:
                own = out.spread[path]
                own[0] += words[path]
                own[1] += words[path.rpartition("/")[0]]
                own[2] += 1
                own[3] += path in heads
    for p in all_:
        main = out.main(p)
        labels: tuple[set, set] = (set(), set())
        for t in p:
            within = t.path.startswith(main + "/") or not t.tag and t.path == main
            if t.tag and t.text[1] != "/" and not main.startswith(t.path):
                labels[within].add(_plain(t.path.rpartition("/")[2]))
            elif t.of:
                labels[within].add(t.of)
        out.outside.update(labels[0])
        out.inside.update(labels[1])
    return out


def group_texts(pages: list[str | None], hosts: list[str] | None = None, known: Template | None = None) -> list[str]:
    """Main text of each page of one group, through the group's template or the ``known`` one."""
    parsed = [parse(p) for p in pages]
    hosts = hosts or [""] * len(pages)
    if known is None:
        parsed = told_apart(parsed, hosts)
        known = deduce(parsed, hosts)
    return ["\n".join(known.blocks(t, h)) for t, h in zip(parsed, hosts, strict=True)]


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """page_id, url, text, n_chars of each row.

    Null html gives an empty text; rows with a null url form a host of their own; repeated rows and null ids stay;
    an empty table gives no row; other columns are ignored, whatever their names.  A host of any size is dealt into
    groups of about ``group`` pages by a hash, and hosts of fewer pages are put together, each whole, into groups of
    about that size, so no group grows with the input.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    counts = cut(src.select(host.alias("name")).groupBy("name").count())
    sums = counts.agg(F.count("*").alias("hosts"), F.sum(F.when(F.col("count") <= group, F.col("count"))).alias("small")).first()
    counts = F.broadcast(counts) if sums.hosts <= 100_000 else counts  # checked: one short row a host
    large = F.col("count") > group
    salt = F.when(large, F.pmod(F.xxhash64("page_id", "url"), F.ceil(F.col("count") / group))).otherwise(F.pmod(F.xxhash64("host"), F.lit(-(-int(sums.small or 0) // group) or 1)))
    dealt = src.withColumn("host", host).join(counts, F.col("host") == F.col("name")).select("page_id", "url", "html", "host", F.when(large, F.col("host")).alias("whose"), salt.alias("salt"))

    def texts(t: pa.Table) -> pa.Table:
        found = group_texts(t.column("html").to_pylist(), t.column("host").to_pylist())
        return pa.Table.from_batches([arrow(page_id=t.column("page_id").combine_chunks(), url=t.column("url").combine_chunks(), text=pa.array(found, pa.string()), n_chars=[len(x) for x in found])])

    return dealt.groupBy("whose", "salt").applyInArrow(texts, "page_id long, url string, text string, n_chars long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all ``pages``."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op6_extract_template": op6}
SQL: dict[str, str] = {}
