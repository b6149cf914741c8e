"""Main text of pages by wrapper induction.

Pages become element trees. Pages of a host are folded into one wrapper: simple tree
matching aligns a page with the wrapper, aligned nodes are counted together, others are
added. Elements are equal if tag, role and the words of class and id are; words that fewer than
SHARED of the host's pages have, as slugs and tags of single articles, do not count, unless they
are votes (below). Runs of equal siblings, as paragraphs or list items, are one repeated node, so a
wrapper stays as small as the host's layout; beyond NODES nodes it drops those of the fewest pages.
Each partition folds its own pages, then the wrappers of a host are folded in two steps, a
sixteenth of them first; all pages count.

A wrapper node whose own text is the same on nearly all pages is template. An element,
role, class or id that speaks of menus, headers, footers, sidebars, notices, adverts, forms
or comments is a vote only: such a node is template if it holds a small share of the text
that varies outside links on the pages that have it, and is kept otherwise. What varies is
content if it lies in an article or main element or, in a layout without one, below the
lowest node that holds all varying text outside links; there, what is links only is left out
unless it is a heading or lies in the node that holds most of that text. A page is aligned with its host's
wrapper again and the text of content nodes is read in page order. A page that has content
nodes below nodes voted out only, or no content node at all, is judged by its own shares.

Defined results: a null or empty page, and one without content, has an empty text; pages
with a null or malformed url share the host ''; a page that does not fit its wrapper is
judged by its own elements; repeated pages of a partition count once for the wrapper and
get their text each; an element below DEPTH others leaves its text, in order, to the one it
lies in, unless it is an article, main or voted one less than twice as deep; extra columns pass through, one named as the result is replaced; an
empty table stays empty.
"""

from __future__ import annotations

import html
import json
import re
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadowlark.llm.batches import bound_batches, free_name, written
from meadowlark.llm.url_filters import host_of

CONSTANT = 0.9  # share of a host's pages on which a template text is the same
LEAST_PAGES = 5  # pages from which constancy is believed
TEXTS = 8  # candidates for a node's constant text
LOST = -1  # the key, no checksum, of what their counts may be too low by
MAIN_SHARE = 0.7  # of the varying text, for a child to be entered in search of the node whose links are content too
SMALL_SHARE = 0.25  # of the varying text, below which a node's name may speak against it
OWN_SHARE = 0.7  # of the text of a page without content nodes, from which a name does not count
SHARED = 0.1  # of a host's pages, from which a word of class or id tells elements apart
NODES = 4000  # of a wrapper
KNOWN = 20_000  # start tags whose signatures a task remembers for a host
HELD = 300_000  # counts of class words that a task holds before it sends them
DEPTH = 64  # elements from which plain ones dissolve into their parents; twice as many, and all do
BROADCAST_BYTES = 32 << 20  # of wrappers sent to every executor; more are joined by a shuffle
SALTS = 16

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe svg".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span "
                    "strike strong sub sup time tt u var wbr del img".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
                    "h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_ENDS_SELF = {"li": "li", "dt": "dt dd", "dd": "dt dd", "option": "option", "tr": "tr td th", "td": "td th", "th": "td th",
              "thead": "tr td th", "tbody": "thead tbody tr td th", "tfoot": "tbody tr td th"}
_SCOPE = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select",
          "thead": "table", "tbody": "table", "tfoot": "table"}
_NEVER_TAGS = frozenset("script style noscript template iframe svg button select textarea head title canvas object audio video".split())
_NOISE_TAGS = frozenset("nav footer aside menu dialog".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
_NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu "
                         "breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice notices popup modal overlay "
                         "newsletter subscribe subscription comment comments disqus reply replies share sharing social related "
                         "recommended widget login signup pagination pager banner".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_COMMENT_WORDS = frozenset("comment comments reply".split())
_HEADER_WORDS = frozenset("header masthead topbar".split())
_VOTE_WORDS = _NOISE_WORDS | _COMMENT_WORDS | _HEADER_WORDS
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]*/\s*\Z")  # a value that ends in a slash, which closes nothing
_NAMES = re.compile(r"(?i)\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")


class Node:
    """An element: its children are nodes and texts in page order."""

    __slots__ = ("tag", "sig", "noise", "children", "up", "depth")

    def __init__(self, tag: str, sig: str, up):
        self.tag, self.sig, self.noise, self.children, self.up = tag, sig, _vote(sig), [], up
        self.depth = up.depth + 1 if up is not None else 0


def _words(value: str) -> set[str]:
    return set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())) - {""}


def _signature(tag: str, raw: str, shared: frozenset | None) -> str:
    """Element, words of class and id, and marks of its role, of being hidden and of being no link."""
    if not raw.strip(" /\n\t"):
        return "a.~anchor" if tag == "a" else tag
    given = {m[1].lower() if m[1] else m[5].lower(): next((x for x in (m[2], m[3], m[4]) if x is not None), "") for m in _ATTRIBUTE.finditer(raw)}
    names = sorted(x for x in _words(given.get("class", "")) | _words(given.get("id", "")) if shared is None or x in shared or x in _VOTE_WORDS)
    role = given.get("role", "").strip().lower().replace(".", " ")
    hidden = "hidden" in given or re.search(r"display\s*:\s*none", given.get("style", ""), re.I)
    return ".".join([tag, *names, *(["~" + role] if role else []), *(["~~hidden"] if hidden else []),
                     *(["~anchor"] if tag == "a" and "href" not in given else [])])


_VOTES: dict[str, str] = {}  # of signatures met in a task


def _vote(sig: str) -> str:
    if (vote := _VOTES.get(sig)) is None:
        if len(_VOTES) > 1 << 16:
            _VOTES.clear()
        vote = _VOTES[sig] = _new_vote(sig)
    return vote


def _new_vote(sig: str) -> str:
    """What a signature says against an element: 'never' text of an article, 'tag', 'name', 'header', or ''."""
    tag, *names = sig.split(".")
    if tag in _NEVER_TAGS:
        return "never"
    if tag in _NOISE_TAGS or "~~hidden" in names or any(x[1:] in _NOISE_ROLES for x in names if x.startswith("~")):
        return "tag"
    if tag == "form" or tag not in ("html", "body", "article", "main") and not _NOISE_WORDS.isdisjoint(names) \
            or tag == "article" and not _COMMENT_WORDS.isdisjoint(names):
        return "name"
    return "header" if tag == "header" or tag not in ("html", "body", "article", "main") and not _HEADER_WORDS.isdisjoint(names) else ""


def parse(page: str, shared: frozenset | None = None, known: dict | None = None) -> Node:
    """The element tree of a page, with the usual implied end tags. ``shared`` are the words of
    class and id that count, None for all; ``known`` keeps the signatures of start tags met with them."""
    known = {} if known is None else known
    root = here = Node("", "", None)
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            loose = _LOOSE.search(page, at)
            if not loose:
                here.children.append(page[at:])
                break
            m = loose
        if m.start() > at:
            here.children.append(page[at: m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            x = here
            while x is not None and x.tag != tag:
                x = x.up
            if x is not None and x.up is not None:
                here = x.up
            continue
        if tag in _ENDS_P or tag in _ENDS_SELF:
            ends = {"p"} if tag in _ENDS_P else set(_ENDS_SELF[tag].split())
            stop = set(_SCOPE.get(tag, "").split()) or {"article", "div", "section", "td", "th", "li", "body", "main", "blockquote"}
            x, closed = here, None
            while x.up is not None and x.tag not in stop:
                if x.tag in ends:
                    closed = x
                x = x.up
            if closed is not None:
                here = closed.up
        if (sig := known.get((tag, m[3]))) is None:
            sig = _signature(tag, m[3], shared)
            if len(m[3]) < 200 and len(known) < KNOWN:
                known[tag, m[3]] = sig
        node = Node(tag, sig, here)
        if node.depth > DEPTH and node.noise != "never" and (node.depth > 2 * DEPTH or not node.noise and tag not in ("article", "main")):
            node.depth, node.children = here.depth, here.children  # dissolved: what it holds is its parent's
            if tag not in _INLINE:
                here.children.append(" ")
        else:
            here.children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}[\s/>]|</{tag}\Z", re.I).search(page, at)
            stop = end.start() if end else size
            if tag in ("title", "textarea"):
                node.children.append(page[at:stop])
            close = page.find(">", stop)
            at = size if not end or close < 0 else close + 1
        elif tag not in _VOID and (not m[3].rstrip().endswith("/") or _UNQUOTED.search(m[3])):
            here = node
    return root


# A wrapper node is [signature, pages, characters, characters in links, {text hash: pages} or None, children];
# None stands for texts that vary within one page, as those of a repeated node.

def skeleton(node: Node, in_link: bool = False) -> list:
    """A page's tree as a wrapper of one page."""
    own, chars, linked, children = [], 0, 0, []
    in_link = in_link or node.tag == "a" and not node.sig.endswith(".~anchor")
    for x in node.children:
        if isinstance(x, str):
            if text := x.strip():
                own.append(text)
                chars += len(text)
        else:
            child = skeleton(x, in_link)
            if children and children[-1][0] == child[0]:
                children[-1] = fold(children[-1], child, same_page=True)
            else:
                children.append(child)
            chars += child[2]
            linked += child[3]
    texts = {zlib.crc32(" ".join(" ".join(own).split()).encode()): 1} if own else {}
    return [node.sig, 1, chars, chars if in_link else linked, texts, children]


def match(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two nodes with equal signatures: the number of node pairs, and the
    pairs of their children, in order and not crossing."""
    m, n = len(a[5]), len(b[5])
    names = [x[0] for x in a[5]]
    if names == [x[0] for x in b[5]] and len(set(names)) == m:  # the only alignment of all children
        return 1 + sum(match(x, y)[0] for x, y in zip(a[5], b[5])), [(i, i) for i in range(m)]
    score = [[0] * (n + 1) for _ in range(m + 1)]
    gain = {}
    for i in range(m):
        for j in range(n):
            if a[5][i][0] == b[5][j][0]:
                gain[i, j] = match(a[5][i], b[5][j])[0]
            score[i + 1][j + 1] = max(score[i][j + 1], score[i + 1][j], score[i][j] + gain.get((i, j), 0))
    pairs, i, j = [], m, n
    while i and j:
        if (i - 1, j - 1) in gain and score[i][j] == score[i - 1][j - 1] + gain[i - 1, j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif score[i][j] == score[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + score[m][n], pairs[::-1]


def fold(a: list, b: list, same_page: bool = False) -> list:
    """Two aligned wrappers as one; nodes of either that have no partner stay in order."""
    _, pairs = match(a, b)
    children, i, j = [], 0, 0
    for x, y in [*pairs, (len(a[5]), len(b[5]))]:
        children += a[5][i:x] + b[5][j:y]
        if x < len(a[5]):
            children.append(fold(a[5][x], b[5][y], same_page))
        i, j = x + 1, y + 1
    if same_page or a[4] is None or b[4] is None:
        texts = None if a[4] != b[4] or not same_page else a[4]
    else:
        texts = dict(a[4])
        for k, v in b[4].items():
            texts[k] = texts.get(k, 0) + v
        counts = sorted((v for k, v in texts.items() if k != LOST), reverse=True)
        if len(counts) > TEXTS:  # Misra-Gries: all counts fall by that of the next text, at most pages / (TEXTS + 1) in sum
            lost = counts[TEXTS]
            texts = {LOST: texts.get(LOST, 0) + lost, **{k: v - lost for k, v in texts.items() if k != LOST and v > lost}}
    return [a[0], max(a[1], b[1]) if same_page else a[1] + b[1], a[2] + b[2], a[3] + b[3], texts, children]


def _size(x: list) -> int:
    return 1 + sum(_size(c) for c in x[5])


def bounded(x: list, most: int = 0) -> list:
    """A wrapper of at most ``most`` nodes: those on the fewest pages go, with what is below them."""
    most = most or NODES
    if _size(x) <= most:
        return x
    counts = []

    def count(y):
        counts.append(y[1])
        for c in y[5]:
            count(c)

    count(x)
    least = sorted(counts, reverse=True)[most // 2]  # half of the room stays free, so this is seldom done

    def kept(y):
        return [*y[:5], [kept(c) for c in y[5] if c[1] > least]]

    return kept(x)


def _fold_all(wrappers: list[list]) -> list:
    out = wrappers[0]
    for x in wrappers[1:]:
        out = bounded(fold(out, x))
    return out


def rules(wrapper: list) -> list:
    """The wrapper as nodes [signature, label, constant text hash or None, children]; the label is
    'main' for a content node, 'noise' for one that is voted out, 'links' for one of links only that is none, else ''."""
    pages = wrapper[1]

    def constant(x):
        if not x[4] or pages < LEAST_PAGES:
            return None
        text, n = max(((k, v) for k, v in x[4].items() if k != LOST), key=lambda t: (t[1], -t[0]), default=(None, 0))
        return text if text is not None and n + x[4].get(LOST, 0) >= CONSTANT * x[1] and x[1] >= LEAST_PAGES else None

    varying, holds = {}, {}  # of every node: varying characters outside links, and whether an article or main is in it

    def weigh(x):
        for c in x[5]:
            weigh(c)
        never = _vote(x[0]) == "never"
        own = x[2] - x[3] - sum(c[2] - c[3] for c in x[5])
        varying[id(x)] = 0 if never else sum(varying[id(c)] for c in x[5]) + (own if constant(x) is None else 0)
        holds[id(x)] = not never and (_is_article(x[0]) or any(holds[id(c)] for c in x[5]))

    weigh(wrapper)

    def small(x):  # share of the varying text of an average page, on the pages that have the node
        return not varying[id(x)] or varying[id(x)] * pages < SMALL_SHARE * varying[id(wrapper)] * x[1]

    def noisy(x):
        vote = _vote(x[0])
        return vote == "never" or vote != "" and (small(x) or vote == "tag" and pages < LEAST_PAGES and not holds[id(x)])

    def free(x):  # varying characters outside links and template
        if noisy(x):
            return 0
        return varying[id(x)] - sum(varying[id(c)] - free(c) for c in x[5])

    found = set()

    def semantic(x):
        if x[0].split(".")[0] in ("article", "main") and not noisy(x):
            found.add(id(x))
        elif not noisy(x):
            for c in x[5]:
                semantic(c)

    def enter(x, share):  # down to the node none of whose children holds that share
        while x[5] and free(x):
            top = max(x[5], key=free)
            if free(top) < share * free(x) or top[0].split(".")[0] in _INLINE | {"p", "li", "td"}:
                break
            x = top
        return x

    def mark_links(x):
        tag, own = x[0].split(".")[0], varying[id(x)] - sum(varying[id(c)] for c in x[5])
        for c in x[5]:
            if not free(c) and c[3] and (not own or c[0].split(".")[0] not in _INLINE) and c[0].split(".")[0] not in _HEADINGS:
                links.add(id(c))
            elif c is not inner and c[0].split(".")[0] not in _HEADINGS:
                mark_links(c)

    semantic(wrapper)
    links = set()
    if not found:
        node = enter(wrapper, 1)
        found.add(id(node))
        inner = enter(node, MAIN_SHARE)
        if inner is not node:
            mark_links(node)

    def labelled(x):
        return [x[0], "main" if id(x) in found else "noise" if noisy(x) else "links" if id(x) in links else "", constant(x), [labelled(c) for c in x[5]]]

    return labelled(wrapper)


def _is_article(sig: str) -> bool:
    return sig.split(".", 1)[0] in ("article", "main") and _vote(sig) == ""


def _aligned(node: Node, rule: list, labels: dict) -> None:
    """Labels of the page's nodes from the wrapper nodes they align with."""
    labels[id(node)] = rule
    runs, last = [], None
    for c in node.children:
        if not isinstance(c, str):
            if last is not None and c.sig == last:
                runs[-1].append(c)
            else:
                runs.append([c])
                last = c.sig
    left = [None] * 5 + [[_shape(r) for r in runs]]
    right = [None] * 5 + [[_rule_shape(x) for x in rule[3]]]
    for i, j in match(left, right)[1]:
        for c in runs[i]:
            _aligned(c, rule[3][j], labels)


def _shape(run: list[Node]) -> list:
    children = []
    for node in run[:1]:
        for c in node.children:
            if not isinstance(c, str) and (not children or children[-1][0] != c.sig):
                children.append([c.sig, 0, 0, 0, None, []])
    return [run[0].sig, 0, 0, 0, None, children]


def _rule_shape(rule: list) -> list:
    return [rule[0], 0, 0, 0, None, [[c[0], 0, 0, 0, None, []] for c in rule[3]]]


def read(page: str, wrapper: list | None, shared: frozenset | None = None, known: dict | None = None) -> str:
    """The main text of a page."""
    root = parse(page, shared, known)
    labels: dict[int, list] = {}
    if wrapper:
        _aligned(root, wrapper, labels)
    text = _content(root, labels, True)
    return text or _content(root, labels, False)


def _weights(node: Node, out: dict, in_link: bool = False) -> tuple[int, bool]:
    """(characters outside links, whether an article or main is in it) of every node of a page."""
    in_link = in_link or node.tag == "a" and not node.sig.endswith(".~anchor")
    chars, holds = 0, _is_article(node.sig)
    for c in node.children:
        if isinstance(c, str):
            chars += 0 if in_link else len(c.strip())
        elif c.noise != "never":
            n, held = _weights(c, out, in_link)
            chars, holds = chars + n, holds or held
    out[id(node)] = chars, holds
    return chars, holds


def _reaches(root: Node, cut, wanted) -> bool:
    """Whether a wanted node can be reached from the root without entering one that is cut."""
    stack = [(root, False)]
    while stack:
        x, article = stack.pop()
        if cut(x, article):
            continue
        if wanted(x):
            return True
        article = article or x.tag in ("article", "main")
        stack += [(c, article) for c in x.children if not isinstance(c, str)]
    return False


def _content(root: Node, labels: dict, drop_constants: bool) -> str:
    weights: dict[int, tuple[int, bool]] = {}

    def own_cut(node, article):  # the page's own judgement
        if not node.noise or node.noise == "header" and article:
            return False
        rule = labels.get(id(node))
        if node.noise == "never":
            return True
        if rule is not None and rule[1] != "noise" or weights[id(node)][1]:
            return False
        return node.noise == "tag" or weights[id(node)][0] < OWN_SHARE * weights[id(root)][0] or not weights[id(node)][0]

    def wrapper_cut(node, article):
        rule = labels.get(id(node))
        if rule is not None and rule[1] == "links":
            return True
        if not node.noise or node.noise == "header" and article:
            return False
        return node.noise == "never" or (rule[1] == "noise" if rule is not None else own_cut(node, article))

    def is_main(node):
        rule = labels.get(id(node))
        return rule is not None and rule[1] == "main"

    def is_article(node):
        return _is_article(node.sig) and weights[id(node)][0] >= SMALL_SHARE * weights[id(root)][0]

    _weights(root, weights)
    own = not _reaches(root, wrapper_cut, is_main)  # the page does not fit: its article or main element, else all that is not noise
    cut = own_cut if own else wrapper_cut
    marked = own and _reaches(root, cut, is_article)
    out: list[str] = []

    def walk(node, inside, article):
        rule = labels.get(id(node))
        if cut(node, article):
            return
        article = article or node.tag in ("article", "main")
        inside = inside or (not own and is_main(node)) or (own and (not marked or is_article(node)))
        block = node.tag not in _INLINE
        if block:
            out.append(" ")
        skip = not inside
        if drop_constants and inside and rule is not None and rule[2] is not None:
            texts = [c.strip() for c in node.children if isinstance(c, str) and c.strip()]
            skip = zlib.crc32(" ".join(" ".join(texts).split()).encode()) == rule[2]
        for c in node.children:
            if not isinstance(c, str):
                walk(c, inside, article)
            elif not skip:
                out.append(html.unescape(c) if "&" in c else c)
        if block:
            out.append(" ")

    walk(root, False, False)
    return " ".join("".join(out).split())


def _wrap(batches):
    """One wrapper for each host of a partition, over its distinct pages."""
    held: dict[str, list] = {}
    shared: dict[str | None, tuple[frozenset, dict]] = {}
    seen: set[tuple[str, int, int]] = set()
    for batch in batches:
        for host, page, words in zip(*[c.to_pylist() for c in batch.columns]):
            if not page:
                continue
            if words not in shared:
                if len(shared) >= 64:
                    shared.clear()
                shared[words] = frozenset((words or "").split()), {}
            raw = page.encode()
            key = (host, zlib.crc32(raw), zlib.adler32(raw))
            if key in seen:
                continue
            seen.add(key)
            one = skeleton(parse(page, *shared[words]))
            held[host] = bounded(fold(held[host], one) if host in held else one)
    if held:
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"host": list(held), "part": [part] * len(held), "wrapper": [json.dumps(x) for x in held.values()]},
                                         schema=_WRAPPERS)


def _joined(as_rules: bool):
    def join(batches):
        def done():
            out = rules(_fold_all(group)) if as_rules else _fold_all(group)
            return pa.RecordBatch.from_pydict({"host": [key[0]], "part": [key[1]], "wrapper": [json.dumps(out)]}, schema=_WRAPPERS)

        key, group = None, []
        for batch in batches:
            for host, part, wrapper in zip(*[c.to_pylist() for c in batch.columns]):
                now = (host, 0 if as_rules else part % SALTS)
                if now != key:
                    if group:
                        yield done()
                    key, group = now, []
                group.append(json.loads(wrapper, object_hook=lambda d: {int(k): v for k, v in d.items()}))
                if len(group) == 64:
                    group = [_fold_all(group)]
        if group:
            yield done()

    return join


_WRAPPERS = pa.schema([("host", pa.string()), ("part", pa.int32()), ("wrapper", pa.string())])
_COLUMNS = "host string, part int, wrapper string"


def shared_words(pages: DataFrame, share: float = SHARED) -> DataFrame:
    """(host, words) from (host, html): the words of class and id that at least this share of the host's pages
    have, joined by spaces. They are fewer than a page's words divided by the share."""
    def count(batches):
        held: dict[tuple[str, str], int] = {}
        known: dict[str, set[str]] = {}
        for batch in batches:
            for host, page in zip(*[c.to_pylist() for c in batch.columns]):
                found: set[str] = set()
                for value in {a or b or c for a, b, c in _NAMES.findall(page or "")}:
                    if (words := known.get(value)) is None:
                        words = _words(value)
                        if len(value) < 200 and len(known) < KNOWN:
                            known[value] = words
                    found |= words
                for word in (*found, ""):
                    held[host, word] = held.get((host, word), 0) + 1
            if len(held) > HELD:
                yield sent(held)
                held = {}
        yield sent(held)

    def sent(held):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()),
                                           pa.array(held.values(), pa.int64())], ["host", "word", "n"])

    counted = written(pages.mapInArrow(count, "host string, word string, n long").groupBy("host", "word").agg(F.sum("n").alias("n")), "class-words")
    all_pages = counted.where("word = ''").select(F.col("host").alias("_host"), F.col("n").alias("_pages"))
    often = counted.join(all_pages, F.col("host").eqNullSafe(F.col("_host"))).where(
        (F.col("n") >= share * F.col("_pages")) & ((F.col("n") >= 3) | (F.col("_pages") < 10)))
    return often.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list("word")), " ").alias("words"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) with the rules of each host's wrapper, from (host, html, words)."""
    folded = pages.mapInArrow(_wrap, _COLUMNS)
    salt = (F.col("part") % SALTS).alias("salt")
    once = folded.repartition("host", salt).sortWithinPartitions("host", salt, "part").mapInArrow(_joined(False), _COLUMNS)
    return once.repartition("host").sortWithinPartitions("host", "part").mapInArrow(_joined(True), _COLUMNS).select("host", "wrapper")


def _sized(table: DataFrame, *columns: str) -> DataFrame:
    """A table of one row a host, to be broadcast if its texts are small."""
    total = sum(F.coalesce(F.length(c), F.lit(0)) for c in columns)
    return F.broadcast(table) if (table.agg(F.sum(total)).first()[0] or 0) <= BROADCAST_BYTES else table


def main_text(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of every page."""
    bound_batches(pages.sparkSession)
    host, rule = free_name(pages, "_host"), free_name(pages, "_rule")
    placed = pages.withColumn(host, host_of(F.col(f"`{url}`").cast("string")))
    plain = placed.select(F.col(host).alias("host"), F.col(f"`{page}`").cast("string").alias("html"))
    words = _sized(written(shared_words(plain), "shared-words"), "words")
    named = words.select(F.col("host").alias("_h"), "words")
    made = wrappers(plain.join(named, F.col("host") == F.col("_h"), "left").select("host", "html", "words"))
    made = _sized(written(made.join(words, "host", "left").select("host", "wrapper", "words"), "wrappers"), "wrapper", "words")
    made = made.select(F.col("host").alias("_h"), F.struct("wrapper", "words").alias(rule))

    @F.arrow_udf("string")
    def read_all(htmls: pa.Array, held: pa.Array) -> pa.Array:
        coded = pc.dictionary_encode(held.field("wrapper"))  # each wrapper of a batch is read once
        known = [json.loads(w) if w else None for w in coded.dictionary.to_pylist()]
        shared: dict[str | None, tuple[frozenset, dict]] = {}
        texts = []
        for h, w, names in zip(htmls.to_pylist(), coded.indices.to_pylist(), held.field("words").to_pylist()):
            if names not in shared:
                if len(shared) >= 64:
                    shared.clear()
                shared[names] = frozenset((names or "").split()), {}
            texts.append(read(h, known[w] if w is not None else None, *shared[names]) if h else "")
        return pa.array(texts, pa.string())

    joined = placed.join(made, F.col(host) == F.col("_h"), "left")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() != out.lower()]
    return joined.select(*kept, read_all(F.col(f"`{page}`").cast("string"), F.col(rule)).alias(out))
