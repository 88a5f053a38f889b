"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

Every element that shapes a page has features of its own (tag, attribute tokens, depth), of its
subtree (text, links, density) and of its siblings; gradient-boosted trees give the log-odds that it
holds main text. Decoding keeps a node only if its parent is kept and the best choice below it
gains, so no kept node lies in a dropped one. The trees are trained by Spark ML on pages laid out
by rule with the texts of a bounded sample of the given pages.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import cut
from .html_layouts import FAMILIES, training_page

# HTML's elements without content, without shown text, within a line, and end tags that may be left out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style template noscript textarea title iframe svg object canvas select button datalist audio video noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tbody",), "tbody": ("thead", "tbody")}
SCOPES = frozenset("ul ol dl table div section article main body td th form".split())

TAG_GROUPS = ("article main", "section", "div", "p", "nav menu", "aside", "header", "footer", "ul ol dl", "li dt dd", "table tbody tr td th thead tfoot", "form fieldset", "h1", "h2 h3 h4 h5 h6", "blockquote pre", "figure figcaption", "body html")
TAG_GROUP = {t: k for k, g in enumerate(TAG_GROUPS) for t in g.split()}
#: What attribute tokens speak of; a token belongs to the first that matches.
TOKEN_GROUPS = tuple(
    re.compile(p)
    for p in (
        r"comment|repl(y|ies)|discuss|disqus|respond|feedback|guestbook",
        r"^ads?$|^ad[sv]?box|advert|sponsor|promo|banner|dfp|adsense|outbrain|taboola|^commercial",
        r"cookie|consent|gdpr|notice|alert|popup|modal|overlay|paywall|warning|toast|notification",
        r"nav|menu|breadcrumb|crumb|pager|paginat|toc|tabs?$|skip",
        r"side|rail|widget|related|recommend|popular|trending|more|teaser|archive|tags?$|categor",
        r"share|social|follow|tweet|facebook|bookmark",
        r"foot|copyright|legal|imprint|colophon|disclaimer",
        r"head|masthead|topbar|logo|brand|hero",
        r"form|search|subscribe|newsletter|signup|login|contact|survey|poll",
        r"content|article|post|entry|main|story|body|text|prose|page|blog|hentry",
    )
)
N_TOKENS = len(TOKEN_GROUPS)
#: What the first words of a part say of it.
HINTS = tuple(
    re.compile(p, re.I)
    for p in (
        r"^\W*(\d+ )?(comment|kommentar|commentaire|comentario|discussion|repl(y|ies)\b|leave a (reply|comment)|responses?\b)",
        r"^\W*(©|\(c\)|copyright|all rights|impressum)",
        r"\bcookies?\b|^\W*notice\b",
        r"^\W*(advert|sponsored|ad:|anzeige|publicit|publicidad)",
        r"^\W*(related|popular|more from|categor|archive|tags\b|mehr zum thema|articles li|relacionad)",
        r"^\W*(subscribe|search|sign up|log in|newsletter|anmelden|share|follow us|tweet|teilen|partager)",
    )
)
N_HINTS = len(HINTS)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|/?[a-zA-Z][^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"(class|id|role|aria-label|aria-hidden|style|hidden|itemprop|data-lumaspec)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_SIGNS = re.compile(r"[.,;:!?]")


@lru_cache(maxsize=20_000)
def attribute_facts(attrs: str) -> tuple[tuple[int, ...], bool, str]:
    """Token groups, whether the element is hidden, and the training label if there is one."""
    groups, hidden, label = set(), False, ""
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "data-lumaspec":
            label = value
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            for token in _SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()):
                k = next((k for k, p in enumerate(TOKEN_GROUPS) if p.search(token)), None) if token else None
                if k is not None:
                    groups.add(k)
    return tuple(sorted(groups)), hidden, label


class Dom:
    """Nodes of one page in page order, and its text runs as (node, block, text)."""

    __slots__ = ("parent", "tag", "facts", "runs", "own", "links", "signs", "words", "start", "inputs", "anchors", "hints", "under", "_heading")

    def __init__(self, source: str):
        self.parent, self.tag, self.facts = [-1], ["body"], [((), False, "")]
        self.runs, self.own, self.links, self.signs, self.words, self.start, self.inputs, self.anchors = [], [0], [0], [0], [0], [0], [0], [0]
        #: what a node's first words say, and what the heading before it says
        self.hints, self.under, self._heading = [None], [()], ()
        self._parse(source)

    def _node(self, parent: int, tag: str, facts: tuple, chars: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.facts.append(facts)
        for x in (self.own, self.links, self.signs, self.words, self.inputs, self.anchors):
            x.append(0)
        self.start.append(chars)
        self.hints.append(None)
        self.under.append(self._heading)
        return len(self.parent) - 1

    def _hint(self, node: int, text: str) -> None:
        found = tuple(k for k, p in enumerate(HINTS) if p.search(text[:60]))
        if self.tag[node] in _HEADINGS:
            self._heading = found
        while node >= 0 and self.hints[node] is None:
            self.hints[node] = found
            node = self.parent[node]

    @staticmethod
    def _close(stack: list, opened: dict[str, list[int]], scopes: list[int], k: int) -> tuple[int, int]:
        """Take elements from the stack's ``k``-th on away; how many were unseen, and how many links."""
        unseen = linked = 0
        for name, _ in stack[k:]:
            opened[name].pop()
            unseen += name in UNSEEN
            linked += name == "a"
        while scopes[-1] >= k:
            scopes.pop()
        del stack[k:]
        return unseen, linked

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("body", 0)]  # element and the node that stands for it
        opened: dict[str, list[int]] = {}  # where in the stack elements of a name are, so that no tag walks it
        scopes: list[int] = [0]
        at, block, chars, unseen, linked, n = 0, 0, 0, 0, 0, len(source)
        find = _TAG.search
        while at < n:
            m = find(source, at)
            end = m.start() if m else n
            if end > at and not unseen:
                text = source[at:end]
                if not text.isspace():
                    if "&" in text:
                        text = html_lib.unescape(text)
                    size, node = len(text), stack[-1][1]
                    self.runs.append((node, block, text))
                    self.own[node] += size
                    self.words[node] += text.count(" ") + 1
                    self.signs[node] += len(_SIGNS.findall(text))
                    if linked:
                        self.links[node] += size
                    chars += size
                    if self.hints[node] is None or self.tag[node] in _HEADINGS:
                        self._hint(node, text)
                else:
                    self.runs.append((stack[-1][1], block, " "))
            if not m:
                return
            at = m.end()
            tag = m[2]
            if not tag:
                continue
            tag = tag.lower()
            if m[1]:
                block += tag not in INLINE and tag not in UNSEEN
                if opened.get(tag) and not (tag in INLINE and scopes[-1] > opened[tag][-1]):
                    closed = self._close(stack, opened, scopes, opened[tag][-1])
                    unseen, linked = unseen - closed[0], linked - closed[1]
                continue
            if tag in VOID:
                if tag == "br":
                    self.runs.append((stack[-1][1], block, " "))
                elif tag == "hr":
                    block += 1
                elif tag == "input":
                    self.inputs[stack[-1][1]] += 1
                continue
            if tag in ("html", "body"):
                continue
            ends = ("p",) if tag in CLOSES_P else SAME_ENDS.get(tag)
            while ends:
                k = max((opened[e][-1] for e in ends if opened.get(e)), default=0)
                if not k or k < scopes[-1]:
                    break
                closed = self._close(stack, opened, scopes, k)
                unseen, linked = unseen - closed[0], linked - closed[1]
                if tag != "tr":
                    break
            inline = tag in INLINE
            block += not inline and tag not in UNSEEN
            if tag in RAW:  # its text runs to its own end tag
                close = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else n
                continue
            facts = attribute_facts(m[3]) if m[3] and not m[3].isspace() else ((), False, "")
            node = stack[-1][1]
            if not unseen and tag not in UNSEEN and (not inline or facts[0] or facts[1] or facts[2]):
                node = self._node(node, tag, facts, chars)
            if tag == "a" and not unseen:
                self.anchors[node] += 1
            opened.setdefault(tag, []).append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
            stack.append((tag, node))
            unseen += tag in UNSEEN
            linked += tag == "a"


N_FEATURES = 34 + 2 * N_HINTS + len(TAG_GROUPS) + 1 + N_TOKENS + N_TOKENS + 2 * (len(TAG_GROUPS) + 1)


def node_features(dom: Dom) -> np.ndarray:
    n = len(dom.parent)
    parent = np.asarray(dom.parent)
    own = np.asarray([dom.own, dom.links, dom.words, dom.signs, dom.inputs, [1] * n, [t == "p" for t in dom.tag], [t == "li" for t in dom.tag], dom.anchors], float)
    total = own.copy()
    depth, kids, turn = np.zeros(n), np.zeros(n), np.zeros(n)
    rows, sums = dom.parent, total.T
    for k in range(n - 1, 0, -1):
        sums[rows[k]] += sums[k]
    same: dict[tuple[int, str], int] = {}
    for k in range(1, n):
        p = rows[k]
        depth[k], turn[k] = depth[p] + 1, kids[p]
        kids[p] += 1
        same[p, dom.tag[k]] = same.get((p, dom.tag[k]), 0) + 1
    text, links, words, signs, inputs, nodes, paras, items, anchors = total
    whole = max(text[0], 1.0)
    up = np.maximum(parent, 0)
    brothers = kids[up]
    rest = np.where(brothers > 1, (text[up] - own[0][up] - text) / np.maximum(brothers - 1, 1), 0)
    safe = np.maximum(text, 1.0)
    cols = [
        depth, np.log1p(text), np.log1p(own[0]), links / safe, np.log1p(nodes), safe / nodes, signs / np.maximum(words, 1), text / np.maximum(words, 1),
        turn / np.maximum(brothers, 1), np.log1p(brothers), text / whole, text / np.maximum(text[up], 1), np.log1p(paras), np.log1p(items), inputs,
        np.log1p(np.maximum(rest, 0)), np.asarray([same.get((rows[k], dom.tag[k]), 1) for k in range(n)], float), np.asarray(dom.start) / whole,
        np.asarray([f[1] for f in dom.facts], float), np.log1p(kids), np.log1p(anchors), links / np.maximum(anchors, 1),
    ]
    before, after = np.zeros(n, int), np.zeros(n, int)  # siblings; the root stands for none
    latest: dict[int, int] = {}
    for k in range(1, n):
        before[k] = latest.get(rows[k], 0)
        after[before[k]] = k
        latest[rows[k]] = k
    after[0] = 0
    dense = links / safe
    for near in (before, after):
        there = near > 0
        cols += [np.where(there, np.log1p(text[near]), -1), np.where(there, dense[near], -1), np.where(there, np.log1p(anchors[near]), -1)]
    biggest = np.zeros(n)
    np.maximum.at(biggest, up[1:], text[1:] - links[1:])
    cols += [text[up] / whole, dense[up], np.log1p(paras[up]), np.log1p(anchors[up]), (text - links) / np.maximum(biggest[up], 1), np.log1p(own[0][up])]
    hinted = np.zeros((2 * N_HINTS, n))
    for k in range(n):
        for h in dom.hints[k] or ():
            hinted[h, k] = 1
        for h in dom.under[k]:
            hinted[N_HINTS + h, k] = 1
    cols += list(hinted)
    groups = len(TAG_GROUPS) + 1
    tag = np.asarray([TAG_GROUP.get(t, groups - 1) for t in dom.tag])
    base = len(cols)
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, :base] = np.stack(cols, 1)
    index = np.arange(n)
    out[index, base + tag] = 1
    tokens = base + groups
    above, tags_above = tokens + N_TOKENS, tokens + 2 * N_TOKENS
    out[index, tags_above + groups + tag[up]] = 1
    for k in range(1, n):
        for g in dom.facts[k][0]:
            out[k, tokens + g] = 1
        p = rows[k]
        if p:  # tokens and tags of all that lies around the node
            out[k, above:tags_above] = np.maximum(out[p, above:tags_above], out[p, tokens:above])
            out[k, tags_above : tags_above + groups] = out[p, tags_above : tags_above + groups]
            out[k, tags_above + tag[p]] = 1
    return out


@dataclass(frozen=True)
class NodeModel:
    """Boosted regression trees as arrays: feature (-1: leaf), threshold, left, right, value."""

    trees: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]
    weights: tuple[float, ...]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, np.where(x[rows, f] <= threshold[at], left[at], right[at]), at)
            out += weight * value[at]
        return 2 * out


def with_siblings(dom: Dom, odds: np.ndarray) -> np.ndarray:
    """Log-odds halfway to the mean of a node's like siblings: of one parent, tag, tokens and hints, and
    all mostly links or all mostly not, but for ``p``. A paragraph among paragraphs is seldom unlike
    them."""
    groups: dict[tuple, list[int]] = {}
    for k in range(1, len(odds)):
        kind = dom.parent[k], dom.tag[k], dom.facts[k][:2], dom.hints[k] or (), dom.tag[k] != "p" and 2 * dom.links[k] > dom.own[k], dom.own[k] > 0
        groups.setdefault(kind, []).append(k)
    out = odds.astype(float).copy()
    for at in groups.values():
        out[at] = (out[at] + out[at].mean()) / 2
    return out


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """Nodes kept by the best choice in which every kept node's parent is kept."""
    gain = odds.astype(float).copy()
    gain[0] = 0
    for k in range(len(parent) - 1, 0, -1):
        if gain[k] > 0:
            gain[parent[k]] += gain[k]
    keep = np.zeros(len(parent), bool)
    keep[0] = True
    for k in range(1, len(parent)):
        keep[k] = keep[parent[k]] and gain[k] > 0
    return keep


def kept_text(dom: Dom, keep: np.ndarray) -> str:
    blocks: dict[int, list[str]] = {}
    for node, block, text in dom.runs:
        if keep[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def fit_nodes(pages: DataFrame, sample_pages: int = 200, training_pages: int = 1400, max_chars: int = 200_000, rounds: int = 20, depth: int = 6, seed: int = 11, families: tuple[str, ...] = FAMILIES) -> NodeModel:
    """Train on ``training_pages`` pages laid out by rule around texts of at most ``sample_pages``
    given pages (those of the least hashes, of at most ``max_chars`` characters each; equal pages
    count once). The hashes are ranked alone, so no page but the chosen ones leaves its task."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    spark: SparkSession = pages.sparkSession
    hashed = pages.where(F.length("html").between(1, max_chars)).select("html", F.xxhash64(F.col("page_id").cast("string"), "url", "html").alias("hash"))
    last = hashed.select("hash").distinct().orderBy("hash").limit(sample_pages).agg(F.max("hash")).first()[0]
    some = hashed.where(F.col("hash") <= F.lit(last)).groupBy("hash").agg(F.min("html").alias("html")).orderBy("hash").collect()
    texts = []
    for row in some:
        dom = Dom(row["html"])
        texts += [t for _, _, t in dom.runs if not t.isspace()]
    texts = sorted(set(texts), key=lambda t: (-len(t), t))[: max(1, len(set(texts)) // 2)]  # sentences rather than labels

    def lay_out(batches):
        for batch in batches:
            for number in batch.column(0).to_pylist():
                dom = Dom(training_page(random.Random(seed * 1_000_003 + number), texts, families))
                labels = np.asarray([{"1": 1.0, "0": 0.0}.get(f[2], -1.0) for f in dom.facts])
                x = node_features(dom)[labels >= 0]
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES, x.ravel())
                yield pa.RecordBatch.from_arrays([lists, pa.array(labels[labels >= 0])], names=["f", "label"])

    made = cut(spark.range(0, training_pages, 1, 4).mapInArrow(lay_out, "f array<float>, label double"), "html-training")
    data = made.select(array_to_vector("f").alias("features"), "label").coalesce(2)
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=32).fit(data)

    def flat(root):
        rows: list[list[float]] = []

        def add(node) -> int:
            k = len(rows)
            rows.append([-1, 0.0, 0, 0, node.prediction()])
            if node.subtreeDepth() > 0:
                split = node.split()
                rows[k][:2] = [split.featureIndex(), split.threshold()]
                rows[k][2] = add(node.leftChild())
                rows[k][3] = add(node.rightChild())
            return k

        add(root)
        f, t, le, r, v = zip(*rows, strict=True)
        return np.asarray(f, np.int64), np.asarray(t, float), np.asarray(le, np.int64), np.asarray(r, np.int64), np.asarray(v, float)

    return NodeModel(tuple(flat(t._java_obj.rootNode()) for t in model.trees), tuple(model.treeWeights))


LENIENT = 1.5  # added to log-odds where a page would else have no text


def texts_of(sources: list[str], model: NodeModel) -> list[str]:
    doms = [Dom(s) for s in sources]
    if not doms:
        return []
    features = [node_features(d) for d in doms]
    odds = model.log_odds(np.concatenate(features))
    out, at = [], 0
    for dom, f in zip(doms, features, strict=True):
        own = with_siblings(dom, odds[at : at + len(f)])
        text = kept_text(dom, decode(dom.parent, own))
        if not text and sum(dom.own) > 2 * sum(dom.links):  # an article is likelier than none: what lies not far below even odds
            text = kept_text(dom, decode(dom.parent, own + LENIENT))
        out.append(text)
        at += len(f)
    return out


def main_text(model: NodeModel, column: str = "html") -> Column:
    """The main text of an html column; empty for null and for pages without any."""

    def run(pages: pd.Series) -> pd.Series:
        out: list[str] = []
        for at in range(0, len(pages), 64):
            out += texts_of([p or "" for p in pages.iloc[at : at + 64]], model)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)(F.col(column))


def extract(pages: DataFrame, model: NodeModel | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row: null html and pages without main text have an
    empty text; repeated rows and null ids are kept; an empty table gives no rows."""
    model = model or fit_nodes(pages)
    return pages.select("page_id", "url", main_text(model).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
