"""Markup residue: from text with HTML, Markdown, wiki or LaTeX marks to clean text that keeps its structure.

A text is parsed permissively into a tree: everything that could be a mark is a
node below the node it stands in. Whether it is one is decided by a tree-structured
graphical model. The root's hidden state is the syntax of the page, that of any
other node is an element in a syntax, or plain text. Parent-child potentials
connect them, each node emits what the parser saw, and sum-product messages, upward
and downward, give every node's marginals. All potentials are counted on
labelled pages, which a grammar of the four syntaxes writes.

Defined cases: a null text gives null clean text and no elements, an empty one
stays empty; a construct cut off by the end of the text counts; marks inside
code or a formula, and marks that only build a heading, list, code block or
formula, are no elements of their own; texts are parsed whole, whatever their
length; repeated rows give repeated results; further columns do not matter.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYNTAXES = ("html", "md", "wiki", "tex")
ELEMENTS = ("heading", "list", "code", "formula", "other")
#: Hidden states of nodes: an element in a syntax, plain text, or what merely stands in code or a formula.
STATES = (*[f"{s}.{e}" for s in SYNTAXES for e in ELEMENTS], "text", "inert")
ROOTS = (*SYNTAXES, "plain")

#: What a text without any possible mark lacks; such texts have an empty tree and never leave the JVM.
POSSIBLE = r"(?m)[<&#*_`$\\\[\]{}|=~>]|''|^[ \t]*(?:[-+]|\d{1,9}[.)])[ \t]|^ {4}|^\t|^ {0,3}---|^[:;]"


@dataclass
class Node:
    """A possible mark: what the parser saw, where, its inner text's span, and the nodes inside."""

    seen: str
    start: int
    end: int
    inner: tuple[int, int] = (0, 0)
    children: list[Node] = field(default_factory=list)
    label: str = ""
    #: The text that the children's places refer to, where it is not the page's, as in quotes, whose lines have marks in front.
    within: str | None = None


# --- parsing -------------------------------------------------------------------

_LIST_ENVS = {"itemize", "enumerate", "description"}
_CODE_ENVS = {"verbatim", "lstlisting", "minted", "Verbatim", "alltt", "listing"}
_MATH_ENVS = {"equation", "align", "gather", "multline", "math", "displaymath", "eqnarray", "alignat", "flalign", "split", "array", "cases", "matrix", "pmatrix", "bmatrix"}

_BLOCK = re.compile(
    r"""
    (?=[<\\$])(?:(?P<h_comment><!--.*?(?:-->|\Z))
  | (?P<h_script><(?P<sc>script|style)\b[^>]*>.*?(?:</(?P=sc)\s*>|\Z))
  | (?P<h_pre><pre\b[^>]*>(?P<i_pre>.*?)(?:</pre\s*>|\Z))
  | (?P<w_source><(?P<so>syntaxhighlight|source)\b[^>/]*>(?P<i_source>.*?)(?:</(?P=so)\s*>|\Z))
  | (?P<h_math><math\b[^>]*>(?P<i_math>.*?)(?:</math\s*>|\Z))
  | (?P<h_mathspan><(?P<ms>span|div)\s+class\s*=\s*["']?math\b[^>]*>(?P<i_mathspan>.*?)(?:</(?P=ms)\s*>|\Z))
  | (?P<h_head><h(?P<hl>[1-6])\b[^>]*>(?:(?P<i_hhead>(?:(?!<h[1-6]\b).)*?)</h(?P=hl)\s*>|(?P<i_hopen>[^\n]*?)(?=\n|<(?:p|div|h[1-6]|ul|ol|dl|table|pre|br)\b|\Z)))
  | (?P<h_list><(?P<ul>ul|ol|dl)\b[^>]*>(?P<i_hlist>.*?)(?:</(?P=ul)\s*>|(?=\n\n)|\Z))
  | (?P<t_env>\\begin\{(?P<env>\w+)\*?\}(?P<i_env>.*?)(?:\\end\{(?P=env)\*?\}|\Z))
  | (?P<t_head>\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]\n]*\])?\{(?P<i_thead>(?:[^{}\n]|\{[^{}\n]*\})*)(?:\}|\Z))
  | (?P<f_dd>\$\$(?P<i_dd>[^$]+?)(?:\$\$|\Z))
  | (?P<f_br>(?<!\\)\\\[(?P<i_br>.+?)(?:\\\]|\Z))
  | (?P<f_par>(?<!\\)\\\((?P<i_par>.+?)(?:\\\)|\Z))
  | (?P<f_d>(?<![\w$\\])\$(?P<i_d>(?![\s\d]+[\s,.)])\S(?:[^$\n]*?[^\s$\\])?)\$(?![\w$]))
    )
  | ^(?:(?P<m_fence>^[ ]{0,3}(?P<fe>`{3,}|~{3,})[^\n`]*(?:\n(?P<i_fence>.*?)(?:^[ ]{0,3}(?P=fe)[`~]*[ \t]*$|\Z)|\Z))
  | (?P<w_table>^[ \t]*\{\|.*?(?:^[ \t]*\|\}|\Z))
  | (?P<w_head>^(?P<wh>={1,6})[ \t]*(?P<i_whead>[^=\s](?:[^\n]*?[^=\s])?)[ \t]*(?P=wh)[ \t]*$)
  | (?P<m_setext>^(?P<i_setext>(?![ \t]*(?:[-*+>|#=`~]|\d+[.)])\s?)[^\n]+)\n[ ]{0,3}(?:={3,}|-{3,})[ \t]*$)
  | (?P<m_table>(?:^[ \t]*\|[^\n]*\|[ \t]*(?:\n|\Z)){2,})
  | (?P<m_hr>^[ ]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$)
  | (?P<m_quote>(?:^[ ]{0,3}>[^\n]*(?:\n|\Z))+)
  | (?P<m_fndef>^\[\^[\w-]+\]:[ \t]*)
  | (?P<hash>(?:^\#{1,6}(?!\#)[^\n]*\S[^\n]*(?:\n(?=\#)|$))+)
  | (?P<bullets>^[ ]{0,3}(?:[-*+]|\d{1,9}[.)]|\*{2,6})[ \t]+[^\s][^\n]*(?:\n(?:[ \t]*(?:[-*+]|\d{1,9}[.)]|\*{2,6})[ \t]+[^\s]|[ ]{2,}\S|\*+\S)[^\n]*)*)
  | (?P<tight>^\*+(?![\s*])[^*\n]+(?:\n\*+[ \t]*(?![\s*])[^*\n]+)*$)
  | (?P<w_def>^[;:]+[ \t]*[^\s:;][^\n]*(?:\n[;:]+[ \t]*\S[^\n]*)*)
  | (?P<m_indent>(?:(?<=\n\n)|\A)(?:(?:[ ]{4}|\t)[ \t]*\S[^\n]*(?:\n|\Z)(?:[ \t]*\n(?=[ ]{4}|\t))*)+)
    )
    """,
    re.X | re.M | re.S | re.I,
)
_INLINE = re.compile(
    r"""
    (?=[<&`!\[*_~'{\\])(?:(?P<w_ref><ref\b[^>/]*(?:/>|>.*?(?:</ref\s*>|\Z)))
  | (?P<h_tag></?[a-z][\w:-]*(?:\s[^<>]*)?/?>)
  | (?P<h_cut><[a-z][\w:-]*(?:\s+[\w:-]+\s*=\s*(?:"[^"<>\n]*|'[^'<>\n]*|[^\s"'<>]+))?(?=\Z|\n)|</?[a-z][\w:-]*\Z)
  | (?P<h_esc>&lt;/?[a-z][\w:-]*(?:\s[^<>&]*)?/?&gt;)
  | (?P<h_ent>&(?:\#\d{1,7}|\#x[0-9a-f]{1,6}|[a-z][a-z0-9]{1,31});)
  | (?P<m_code>(?<!`)(?P<tick>`{1,2})(?!`)[^`\n]+(?P=tick)(?!`))
  | (?P<m_link>!?\[[^\[\]\n]*\]\((?:[^()\s]|\([^()\s]*\))*(?:[ ]"[^"\n]*")?\))
  | (?P<m_fn>\[\^[\w-]+\])
  | (?P<m_auto><https?://[^>\s]+>)
  | (?P<m_ref>\[[^\[\]\n]+\]\[[^\[\]\n]*\])
  | (?P<m_strong>(?<![\w*])(?P<st>\*{2,3})(?=[^\s*])[^*\n]+?(?<=[^\s*])(?P=st)(?![\w*]))
  | (?P<m_em>(?<![\w*])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*]))
  | (?P<m_us>(?<![\w_])(?P<us>_{1,3})(?=[^\s_])[^_\n]+?(?<=[^\s_])(?P=us)(?![\w_]))
  | (?P<m_del>~~(?=\S)[^~\n]+?~~)
  | (?P<w_em>(?<!')(?P<qu>'{2,5})(?!')[^\n]+?(?P=qu)(?!'))
  | (?P<w_link>\[\[[^\[\]\n]+\]\])
  | (?P<w_ext>\[(?:https?|ftp|mailto):[^\s\]]+(?:[ ][^\]\n]*)?\])
  | (?P<w_tpl>\{\{(?:[^{}]|\{\{[^{}]*\}\})*\}\})
  | (?P<w_word>__[A-Z]{3,}__)
  | (?P<t_group>\{\\(?:it|bf|em|tt|sc|rm|sl|sf|small|large|tiny|bfseries|itshape|ttfamily)\b[^{}]*\})
  | (?P<t_cmd>(?:~|(?<![\w:\\]))\\[a-z]+\*?(?:\[[^\]\n]*\])?(?:\{(?:[^{}]|\{[^{}]*\})*\})+)
  | (?P<t_bare>(?<![\w:\\])\\[a-z]{2,}\*?(?![\w\\{]))
  | (?P<t_esc>(?<![\w:\\])\\[%&_\#{}$])
    )
    """,
    re.X | re.S | re.I,
)
#: The blocks that may stand within a line, and so in items, headings and quotes.
_LOOSE = re.compile(_BLOCK.pattern.split("\n  | ^(?:")[0], _BLOCK.flags)
_ITEM_MARK = re.compile(r"</?(?:li|ul|ol|dl|dt|dd)\b[^>]*>|\\item\b[ \t]*(?:\[[^\]]*\])?|^[ \t]*(?:[-*+]|\d{1,9}[.)]|\*{2,6})[ \t]+(?:\[[ xX]\][ \t]+)?|^[#*;:]+[ \t]*", re.M | re.I)
_PRE_CODE = re.compile(r"\s*</?code\b[^>]*>\s*", re.I)
_WORDY = re.compile(r"[\\^_={}<>+]|[a-zA-Z]\(|\d\s*[*/-]\s*\d|^\w$")


def _shape_of_lines(body: str, mark: str) -> str:
    lines = [x for x in body.split("\n") if x.strip()]
    if mark == "hash":
        closed = any(re.search(r"#\s*$", x) for x in lines)
        deep = any(x.startswith("##") for x in lines)
        space = all(re.match(r"#+[ \t]", x) for x in lines)
        level = "deep" if deep else "flat"
        return f"hash_{level}_{'many' if len(lines) > 1 else 'one'}_{'closed' if closed else 'spaced' if space else 'tight'}"
    first = body.lstrip()[:2]
    kind = "num" if first[0].isdigit() else {"-": "dash", "+": "plus"}.get(first[0], "star")
    tight = any(re.match(r"[*#]+[^\s*#]", x) for x in lines)
    nested = any(re.match(r"\*{2,}", x) for x in lines)
    return f"{mark}_{kind}_{'many' if len(lines) > 1 else 'one'}{'_tight' if tight else '_wiki' if nested else ''}"


def _inline(text: str, a: int, b: int, skip_items: bool = False) -> list[Node]:
    out = []
    for m in _INLINE.finditer(text, a, b):
        if skip_items and _ITEM_MARK.fullmatch(m.group()):
            continue
        kind = m.lastgroup
        if kind == "h_tag":
            name = re.match(r"</?([\w:-]+)", m.group()).group(1).lower()
            kind = "h_tag_item" if name in {"li", "dt", "dd"} else "h_tag_word" if not m.group().endswith("/>") and name not in _HTML_NAMES else "h_tag"
        out.append(Node(kind, m.start(), m.end(), (m.start(), m.end())))
    return out


#: What blocks may stand in, besides lines of items and of headings with hashes.
_HOLDERS = frozenset("t_env h_list t_list h_head t_head w_head m_setext m_quote w_def".split()) | {
    *(f"{m}_{k}_{n}{e}" for m in ("bullets", "tight") for k in ("num", "dash", "plus", "star") for n in ("one", "many") for e in ("", "_tight", "_wiki"))
}
_HTML_NAMES = frozenset(
    """a abbr article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn div em figcaption figure font footer form h1 h2 h3 h4 h5 h6
    head header hr html i iframe img input ins kbd label legend link main mark meta nav noscript object ol option p param pre q s samp section select small source span strike
    strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr nowiki gallery poem references includeonly noinclude onlyinclude""".split()
)
_INLINE_KINDS = tuple(k for k in _INLINE.groupindex if k[1:2] == "_")
_INNER = {"h_pre": "i_pre", "w_source": "i_source", "h_math": "i_math", "h_mathspan": "i_mathspan", "h_head": "i_hhead", "h_list": "i_hlist", "t_env": "i_env", "t_head": "i_thead",
          "m_fence": "i_fence", "f_dd": "i_dd", "f_br": "i_br", "f_par": "i_par", "f_d": "i_d", "w_head": "i_whead", "m_setext": "i_setext"}


#: Levels of blocks in blocks; what stands deeper has inline marks only. Levels of HTML tags in tags; deeper ones are leaves.
_DEPTH, _TAG_DEPTH = 6, 24
_LIST_TAG = re.compile(r"<(/?)(?:ul|ol|dl)\b[^>]*>", re.I)
_TAG = re.compile(r"<(/?)([a-z][\w:-]*)[^<>]*?(/?)>", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_QUOTE_MARK = re.compile(r"^[ ]{0,3}>[ ]?", re.M)


def _closed_lists(text: str) -> dict[int, tuple[int, int]]:
    """By the place of a list's opening tag, the span of the closing tag that belongs to it."""
    out, open_ = {}, []
    for m in _LIST_TAG.finditer(text):
        if not m.group(1):
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.span()
    return out


def _nested(nodes: list[Node], text: str) -> list[Node]:
    """HTML tags with what stands between them as their children: the tree that the page's own tags describe."""
    out: list[Node] = []
    open_: list[tuple[str, int]] = []
    for n in nodes:
        m = _TAG.fullmatch(text, n.start, n.end) if n.seen == "h_tag" else None
        name = m.group(2).lower() if m else ""
        if m and m.group(1):
            at = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), None)
            if at is not None:
                holder = out[open_[at][1]]
                holder.children, holder.inner, holder.end = out[open_[at][1] + 1 :], (holder.end, n.start), n.end
                del out[open_[at][1] + 1 :], open_[at:]
                continue
        elif m and not m.group(3) and name not in _VOID and len(open_) < _TAG_DEPTH:
            open_.append((name, len(out)))
        out.append(n)
    return out


def parse(text: str, a: int = 0, b: int | None = None, blocks: re.Pattern = _BLOCK, items: bool = False, depth: int = 0, lists: dict | None = None) -> list[Node]:
    """The top nodes of a text's (or a span's) tree, in order."""
    out: list[Node] = []
    at, b = a, len(text) if b is None else b
    if lists is None:
        lists = _closed_lists(text)
    while m := blocks.search(text, at, b):
        kind, end = m.lastgroup, m.end()
        out += _inline(text, at, m.start(), items)
        inner = m.span(_INNER[kind]) if kind in _INNER else m.span()
        if kind == "h_head" and inner[0] < 0:
            inner = m.span("i_hopen")
        if kind == "h_list" and (close := lists.get(m.start())) and close[1] <= b:
            inner, end = (inner[0], close[0]), close[1]
        if inner[0] < 0:
            inner = (end, end)
        seen = kind
        if kind == "t_env":
            env = m.group("env")
            seen = "t_list" if env in _LIST_ENVS else "t_verb" if env in _CODE_ENVS else "t_math" if env in _MATH_ENVS else "t_env"
        elif kind == "f_d":
            seen = "f_d" if _WORDY.search(m.group("i_d")) else "f_d_words"
        elif kind in {"hash", "bullets", "tight"}:
            seen = _shape_of_lines(m.group(), kind)
        node = Node(seen, m.start(), end, inner)
        if kind == "m_quote" and depth < _DEPTH:
            node.within = _QUOTE_MARK.sub("", m.group())
            node.children = parse(node.within, depth=depth + 1)
        elif kind not in {"h_comment", "h_script", "w_table", "m_table", "m_hr", "m_fndef"}:
            listed = seen in {"h_list", "t_list"}
            if seen in _HOLDERS and depth < _DEPTH:
                inside = parse(text, *inner, _BLOCK if seen == "t_env" else _LOOSE, listed, depth + 1, lists)
            else:
                inside = _inline(text, *inner, listed)
            node.children = [x for x in inside if not (kind == "h_pre" and _PRE_CODE.fullmatch(text[x.start : x.end]))]
        out.append(node)
        at = max(end, at + 1) if end == m.start() else end
    return _nested(out + _inline(text, at, b, items), text)


# --- the model -----------------------------------------------------------------


@dataclass
class Model:
    """Potentials of the tree: log P(root), log P(child | parent) below the root and deeper, log P(seen | state)."""

    root: np.ndarray
    top: np.ndarray
    below: np.ndarray
    emit: dict[str, np.ndarray]
    unseen: np.ndarray
    memo: dict = field(default_factory=dict)

    def emission(self, seen: str) -> np.ndarray:
        return self.emit.get(seen, self.unseen)


def _signature(node: Node) -> tuple:
    return (node.seen, tuple(sorted(_signature(c) for c in node.children))) if node.children else (node.seen, ())


def _log_dot(matrix: np.ndarray, message: np.ndarray) -> np.ndarray:
    """log of exp(matrix) @ exp(message)."""
    most = message.max()
    return np.log(np.exp(matrix) @ np.exp(message - most)) + most


def marginals(model: Model, tops: tuple) -> dict[tuple, tuple[np.ndarray, dict]]:
    """By signature: posterior marginals and the same of the children, by two passes of sum-product messages.

    Equal subtrees under one parent have equal marginals, so each is computed once
    and counts as often as it occurs.
    """
    below_p, top_p = np.exp(model.below), np.exp(model.top)

    def upward(sig: tuple) -> np.ndarray:
        seen, children = sig
        belief = model.emission(seen).copy()
        for c, n in Counter(children).items():
            inside = upward(c)
            belief += n * (np.log(below_p @ np.exp(inside - inside.max())) + inside.max())
        return belief

    ups = {sig: upward(sig) for sig in dict.fromkeys(tops)}
    to_root = {sig: _log_dot(model.top, up) for sig, up in ups.items()}
    count = Counter(tops)
    root = model.root + sum((n * to_root[s] for s, n in count.items()), np.zeros(len(ROOTS)))

    def downward(sig: tuple, outside: np.ndarray) -> tuple[np.ndarray, dict]:
        """``outside``: log-message from everything that is not below this node, over its states."""
        seen, children = sig
        counted = Counter(children)
        ins = {c: upward(c) for c in counted}
        sent = {c: np.log(below_p @ np.exp(i - i.max())) + i.max() for c, i in ins.items()}
        full = model.emission(seen) + outside + sum((n * sent[c] for c, n in counted.items()), np.zeros(len(STATES)))
        p = np.exp(full - full.max())
        inside = {}
        for c in counted:
            rest = full - sent[c]
            inside[c] = downward(c, np.log(np.exp(rest - rest.max()) @ below_p + 1e-300))
        return p / p.sum(), inside

    out = {}
    for sig in count:
        rest = root - to_root[sig]
        out[sig] = downward(sig, np.log(np.exp(rest - rest.max()) @ top_p + 1e-300))
    return out


LABELS = (*ELEMENTS, "text")
_OF_LABEL = np.array([[s.endswith(e) or e == "text" and s == "inert" for e in LABELS] for s in STATES], float)
_MEMO = 200_000


def decide(model: Model, nodes: list[Node]) -> list[Node]:
    """Labels all nodes with the element of the greatest marginal, summed over syntaxes."""
    if not nodes:
        return nodes
    tops = tuple(sorted(_signature(n) for n in nodes))
    best = model.memo.get(tops)
    if best is None:
        if len(model.memo) >= _MEMO:
            model.memo.clear()
        best = _labels(marginals(model, tops))
        if len(tops) <= 64:
            model.memo[tops] = best

    def walk(many: list[Node], known: dict) -> None:
        for n in many:
            n.label, inside = known[_signature(n)]
            walk(n.children, inside)

    walk(nodes, best)
    return nodes


def _labels(known: dict) -> dict:
    return {sig: (LABELS[int(np.argmax(p @ _OF_LABEL))], _labels(inside)) for sig, (p, inside) in known.items()}


def elements(nodes: list[Node]) -> set[str]:
    """The kinds of elements marked up in a decided tree; what lies in code or formulas is theirs."""
    out: set[str] = set()
    for n in nodes:
        if n.label != "text":
            out.add(n.label)
        if n.label not in {"code", "formula"}:
            out |= elements(n.children)
    return out


# --- labelled pages --------------------------------------------------------------

_NOUNS = "harbour lantern meadow violin copper winter orchard saddle bridge kettle marble feather river tower garden mirror".split()
_VERBS = "carries follows measures paints opens mends watches gathers trades counts".split()
_ADJS = "quiet amber distant narrow early heavy bright hollow gentle crooked".split()


def _words(r: random.Random, n: int) -> str:
    return " ".join(r.choice(r.choice((_NOUNS, _VERBS, _ADJS))) for _ in range(n))


def _sentence(r: random.Random) -> str:
    return f"The {r.choice(_ADJS)} {r.choice(_NOUNS)} {r.choice(_VERBS)} {r.randint(2, 99)} {r.choice(_NOUNS)}s."


def _plain_traps(r: random.Random) -> str:
    """Text that looks a little like markup."""
    a, b = r.randint(2, 9), r.randint(2, 99)
    w = _words(r, 1)
    return r.choice((
        f"It costs ${a} now, not ${b} today.", f"That makes {a} * {b} * {a} {w}s.", f"Version {a}.{b}_{w} fits {w}_{w}_max.", f"It ranks #{b} among {w}s.",
        f"If {a} < {b} and {b} > {a} we stop.", f"He wrote [sic] there, {w} & {w}.", f"The path C:\\{w}\\{w} is gone.", f"Roughly ~{b} {w}s or {a}^{b}.",
        f"The call f({a}, {b}) == {w} fails.", f"#{w} was the tag.", f"It was {a}-{b}-{a}, no more.", f"a | b is a pipe, {{{w}}} a set.", f"R&D and {w}::{w} agree.",
    ))


def _code(r: random.Random) -> str:
    a = _words(r, 1)
    return "\n".join(r.sample((
        f"for {a} in items:", f"    print({a} * 2)  # *all* of it", "#include <stdio.h>", f"if (a < b && c > d) {{ {a}(); }}", "# set up", f"SELECT * FROM {a} WHERE n_x > 3",
        f"let v: Vec<{a}> = new();", f"$x = ${a}[0];", f"echo `date` | {a} --all", f"<div class='{a}'>&amp;</div>", f"{a}->run(&x);", f"return {a}[::-1]",
    ), r.randint(1, 3)))


def _formula(r: random.Random) -> str:
    return r.choice(("x^2 + y^2", r"\frac{a}{b} + c_1", r"\sum_{k=1}^{n} k", "E = m c^2", r"\alpha \le \beta", "a_{i,j} < b_j", r"\sqrt{2} \, t", "n = 4", r"O(n \log n)", "x", r"\int_0^1 f", r"n \choose k", r"A \cup B")) + (f" > {r.choice('abc')}_{r.randint(0, 9)}" if r.random() < 0.3 else "")


def _block(r: random.Random, s: str) -> tuple[str, str]:
    """(text, element) of a block in a syntax."""
    e = r.choice(("heading", "list", "code", "formula", "other", "other", "text", "text"))
    w, items = _words(r, r.randint(1, 4)), [_words(r, r.randint(1, 4)) for _ in range(r.randint(1, 4))]
    if e == "text":
        return r.choice((_sentence, _plain_traps))(r), e
    level = r.randint(1, 6)
    if s == "html":
        made = {
            "heading": f"<h{level}{r.choice(('', ' id=a', ' class=\"t\"'))}>{w}</h{level}>",
            "list": "<{0}>{1}</{0}>".format(r.choice(("ul", "ol")), "\n".join(f"<li>{i}</li>" for i in items)),
            "code": r.choice((f"<pre><code>{html.escape(_code(r))}</code></pre>", f"<pre class=\"c\">{_code(r)}</pre>", f"<pre>{_code(r)}</pre>")),
            "formula": r.choice((f"<math><mi>{w}</mi></math>", f"<span class=\"math\">\\({_formula(r)}\\)</span>", f"$${_formula(r)}$$")),
            "other": r.choice((f"<p>{_sentence(r)}</p>", f"{w} <b>{w}</b> {w}", f"<a href='/x'>{w}</a>", f"it&#39;s {w}&nbsp;{w}", f"{w}<br/>", f"<!-- {w} -->", f"<script>{w}</script>", f"<div>{w}</div>", f"<table><tr><td>{w}</td></tr></table>", f"&lt;p&gt;{w}&lt;/p&gt;", f"<blockquote>{w}</blockquote>", f"so <code>{w}</code> is", f"<p class=\"{w}")),
        }
    elif s == "md":
        mark = r.choice(("-", "*", "+", "1."))
        made = {
            "heading": r.choice((f"{'#' * level} {w}", f"{'#' * level} {w} {'#' * level}", f"{w}\n{'=' * max(3, len(w))}", f"{w}\n{'-' * max(3, len(w))}")),
            "list": "\n".join(f"{'  ' * (k > 0 and r.random() < 0.2)}{k + 1 if mark == '1.' else ''}{'.' if mark == '1.' else mark} {'[ ] ' * (r.random() < 0.2)}{i}" for k, i in enumerate([*items, w])),
            "code": r.choice((f"```py\n{_code(r)}\n```", f"~~~\n{_code(r)}\n~~~", "    " + _code(r).replace("\n", "\n    "))),
            "formula": r.choice((f"$${_formula(r)}$$", f"$$\n{_formula(r)}\n$$", f"so ${_formula(r)}$ holds")),
            "other": r.choice((f"{w} **{w}** here", f"an _{w}_ one", f"a `{w}` there", f"[{w}](https://a.example/b)", f"![{w}](https://a.example/b.png)", f"> {_sentence(r)}", f"| a | b |\n|---|---|\n| {w} | c |", f"{w} ~~{w}~~", f"{w}.[^1]", f"[^1]: {w}", f"***{w}***", "---", f"so *{w}* it")),
        }
    elif s == "wiki":
        mark = r.choice(("*", "#", "* ", "# "))
        made = {
            "heading": r.choice((f"{'=' * level} {w} {'=' * level}", f"{'=' * level}{w}{'=' * level}")),
            "list": "\n".join((mark[0] * (2 if k and r.random() < 0.15 else 1) + mark[1:]) + i for k, i in enumerate([*items, w])),
            "code": r.choice((f"<syntaxhighlight lang=\"c\">\n{_code(r)}\n</syntaxhighlight>", f"<source>{_code(r)}</source>", f"<pre>{_code(r)}</pre>")),
            "formula": f"<math>{_formula(r)}</math>",
            "other": r.choice((f"{w} ''{w}'' {w}", f"'''{w}'''", f"[[{w}]]", f"[https://a.example {w}]", f"{{{{cite|{w}}}}}", f"{w}<ref>{w}</ref>", f"{{| class=\"t\"\n|-\n| {w} || b\n|}}", f"[[{w}|{w}]]", "__NOTOC__")),
        }
    else:
        made = {
            "heading": r.choice((f"\\section{{{w}}}", f"\\subsection*{{{w}}}", f"\\paragraph{{{w}}}")),
            "list": "\\begin{{{0}}}\n{1}\n\\end{{{0}}}".format(r.choice(("itemize", "enumerate", "description")), "\n".join(f"\\item{r.choice(('', '[x]'))} {i}" for i in items)),
            "code": "\\begin{{{0}}}\n{1}\n\\end{{{0}}}".format(r.choice(("verbatim", "lstlisting")), _code(r)),
            "formula": r.choice((f"${_formula(r)}$", f"$${_formula(r)}$$", f"\\[{_formula(r)}\\]", f"\\({_formula(r)}\\)", "\\begin{{{0}}}\n{1}\n\\end{{{0}}}".format(r.choice(("equation", "align*")), _formula(r)))),
            "other": r.choice((f"\\emph{{{w}}} {w}", f"{w}~\\cite{{{w}}}", f"{w} \\ldots {w}", f"{{\\it {w}}} {w}", f"\\begin{{quote}}{w}\\end{{quote}}", f"\\footnote{{{w}}}", f"{w} \\% {w}", f"\\href{{https://a.example}}{{{w}}}")),
        }
    return made[e], e


def _labelled_page(r: random.Random) -> tuple[str, str, list[tuple[int, int, str, str]]]:
    """(text, root state, [(start, end, syntax, element)]) of one page."""
    s = r.choice(ROOTS)
    glue = "\n\n" if s in {"md", "plain"} or r.random() < 0.6 else r.choice(("\n", " ")) if s in {"html", "tex"} else "\n"
    text, spans = "", []
    for _ in range(r.randint(1, 6)):
        syntax = s if s != "plain" and r.random() < 0.93 else r.choice(SYNTAXES)
        block, e = _block(r, syntax) if s != "plain" else (r.choice((_sentence, _plain_traps))(r), "text")
        text += glue if text else ""
        spans.append((len(text), len(text) + len(block), syntax, e))
        text += block
    return text, s, spans


@functools.cache
def train(pages: int = 6000, seed: int = 11, smooth: float = 0.02) -> Model:
    """Counts all potentials on ``pages`` labelled pages (a fixed number, on the driver)."""
    r = random.Random(seed)
    at, root_at = {s: i for i, s in enumerate(STATES)}, {s: i for i, s in enumerate(ROOTS)}
    roots, top, below = np.ones(len(ROOTS)), np.full((len(ROOTS), len(STATES)), smooth), np.full((len(STATES), len(STATES)), smooth)
    emit: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(STATES)))
    for _ in range(pages):
        text, s, spans = _labelled_page(r)
        roots[root_at[s]] += 1
        for n in parse(text):
            span = next(((syntax, e) for a, b, syntax, e in spans if a <= n.start < b), None)
            state = "text" if span is None or span[1] == "text" else f"{span[0]}.{span[1]}"
            if state != "text" and span[1] in ELEMENTS[:4] and n.seen in _INLINE_SEEN:
                state = "inert" if span[1] in {"code", "formula"} else f"{span[0]}.other"
            top[root_at[s], at[state]] += 1
            emit[n.seen][at[state]] += 1
            for c in n.children:
                inner = "inert" if state.endswith((".code", ".formula")) else "text" if state == "text" else f"{span[0]}.other"
                below[at[state], at[inner]] += 1
                emit[c.seen][at[inner]] += 1
    # blocks in blocks, of a stream of their own
    r = random.Random(seed + 1)
    for _ in range(pages // 4):
        s = r.choice(SYNTAXES)
        block, e = _block(r, s)
        holder, around = r.choice({
            "html": (("list", "<ul><li>{}</li></ul>"), ("other", "<div>{}</div>"), ("other", "<td>{}</td>")), "md": (("list", "- so {} it"), ("other", "> so {} it"), ("other", "> {}")),
            "wiki": (("list", "* so {} it"),), "tex": (("list", "\\begin{{itemize}}\n\\item {}\n\\end{{itemize}}"), ("other", "\\begin{{document}}\n{}\n\\end{{document}}")),
        }[s])
        if around == "> {}":
            block = block.replace("\n", "\n> ")
        elif s in {"md", "wiki"} and "\n" in block:
            continue
        if e == "text":
            continue
        for n in parse(around.format(block)):
            for c in n.children:
                if c.seen not in _INLINE_SEEN:
                    below[at[f"{s}.{holder}"], at[f"{s}.{e}"]] += 1
                    emit[c.seen][at[f"{s}.{e}"]] += 1
    total = sum(emit.values()) + smooth * (len(emit) + 1)
    logs = {k: np.log((v + smooth) / total) for k, v in emit.items()}
    norm = lambda m: np.log(m / m.sum(axis=-1, keepdims=True))
    return Model(norm(roots), norm(top), norm(below), logs, np.log(smooth / total))


_INLINE_SEEN = frozenset((*_INLINE_KINDS, "h_tag_item", "h_tag_word"))


# --- clean text -------------------------------------------------------------------


def _tag_text(raw: str) -> str:
    """What an HTML tag leaves behind: a line's or a cell's end, or nothing."""
    return "\n" if re.match(r"</?(?:br|p|div|tr|table|blockquote)\b", raw, re.I) else " " if re.match(r"</t[dh]", raw, re.I) else ""


def _strip(text: str, n: Node) -> str:
    """The readable part of an inline mark or of another element."""
    raw = text[n.start : n.end]
    if n.seen in {"h_comment", "h_script", "h_cut", "m_hr", "w_tpl", "w_word", "t_bare", "m_fn", "m_fndef"}:
        return {"t_bare": "…" if raw in {r"\ldots", r"\dots"} else ""}.get(n.seen, "")
    if n.seen == "h_esc":
        return "\n" if re.match(r"&lt;/?(?:br|p|div|tr|table)\b", raw, re.I) else ""
    if n.seen == "h_ent":
        return html.unescape(raw)
    if n.seen.startswith("h_tag"):
        return _tag_text(raw)
    if n.seen in {"m_link", "m_ref"}:
        return re.match(r"!?\[([^\]]*)\]", raw).group(1)
    if n.seen == "w_link":
        return raw[2:-2].rpartition("|")[2]
    if n.seen == "w_ext":
        return raw[1:-1].partition(" ")[2]
    if n.seen == "w_ref":
        return ""
    if n.seen == "m_auto":
        return raw[1:-1]
    if n.seen == "t_esc":
        return raw[1:]
    if n.seen in {"t_cmd", "t_group"}:
        raw = raw.lstrip("~")
        if re.match(r"\\(?:cite\w*|label|ref|footnote|includegraphics|bibliography)\b", raw):
            return ""
        last = re.search(r"\{((?:[^{}]|\{[^{}]*\})*)\}$", raw)
        return re.sub(r"^\{?\\[a-z]+\*?\s*", "", last.group(1) if n.seen == "t_cmd" and last else raw[:-1])
    if n.seen == "w_table" or n.seen == "m_table":
        rows = [re.sub(r"^\s*\|\s*|\s*\|\s*$", "", x) for x in raw.split("\n") if not re.fullmatch(r"\s*(?:\{\|.*|\|\}|\|-+|[|:\s-]+)\s*", x)]
        return "\n".join(re.sub(r"\s*\|{1,2}\s*", " | ", x) for x in rows)
    return re.sub(r"^(`+|\*+|_+|~~|'{2,5})(.*?)\1$", r"\2", raw, flags=re.S)


def _span(text: str, a: int, b: int, nodes: list[Node]) -> str:
    out, at = [], a
    for n in nodes:
        if n.start < at or n.label == "text" and (not n.children or n.within is not None):
            continue
        if n.label == "text":  # a mark that is none may hold some that are
            a, at_end = max(at, n.inner[0]), n.inner[1]
            out += [text[at:a], _span(text, a, at_end, n.children)]
            at = at_end
            continue
        out += [text[at : n.start], _render(text, n)]
        at = n.end
    return "".join([*out, text[at:b]])


def _render(text: str, n: Node) -> str:
    a, b = n.inner
    if n.label == "formula":
        body = re.sub(r"</?m\w+>", " ", text[a:b]) if n.seen == "h_math" else text[a:b]
        body = re.sub(r"^\s*(?:\\\(|\\\[|\$+)|(?:\\\)|\\\]|\$+)\s*$", "", body)
        return f"${' '.join(body.split())}$"
    if n.label == "code":
        body = _PRE_CODE.sub("\n", text[a:b]) if n.seen == "h_pre" else text[a:b]
        body = html.unescape(body) if n.seen == "h_pre" else body
        if n.seen == "m_indent":
            body = re.sub(r"^(?: {4}|\t)", "", body, flags=re.M)
        return "\n```\n" + body.strip("\n") + "\n```\n"
    if n.seen.startswith("h_tag") and (a, b) != (n.start, n.end):
        return _tag_text(text[n.start : a]) + _span(text, a, b, n.children) + _tag_text(text[b : n.end])
    if n.within is not None:
        return _span(n.within, 0, len(n.within), n.children)
    inside = _span(text, a, b, n.children)
    if n.label == "heading":
        if n.seen.startswith("hash"):
            return "\n".join(re.sub(r"^#+\s*(.*?)\s*#*\s*$", r"# \1", x) for x in inside.split("\n"))
        return f"\n# {' '.join(inside.split())}\n" if n.seen[0] in "ht" else f"# {' '.join(inside.split())}"
    if n.label == "list":
        raw = [x.strip() for x in _ITEM_MARK.split(inside)]
        return ("\n" if n.seen in {"h_list", "t_list"} else "") + "\n".join(f"- {x if '```' in x else ' '.join(x.split())}" for x in raw if x)
    if n.seen == "m_quote":
        return re.sub(r"^[ ]{0,3}>[ ]?", "", inside, flags=re.M)
    if n.seen == "t_env":
        return inside
    return _strip(text, n)


def clean(model: Model, text: str, nodes: list[Node] | None = None) -> str:
    """Clean text: headings as ``# ``, items as ``- ``, fenced code, formulas in dollars, everything else as plain words. ``nodes``: its decided tree, if known."""
    nodes = decide(model, parse(text)) if nodes is None else nodes
    made = _span(text, 0, len(text), nodes)
    return re.sub(r"\n{3,}", "\n\n", made).strip("\n") if nodes else made


# --- over tables --------------------------------------------------------------------


def _possible():
    return F.coalesce(F.col("text_").rlike(POSSIBLE), F.lit(False))


def _analyse(model: Model, cleaned: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, out = [], []
            for text in batch.column("text_").to_pylist():
                nodes = decide(model, parse(text))
                found.append(sorted(elements(nodes)))
                if cleaned:
                    out.append(clean(model, text, nodes))
            made = batch.drop_columns(["text_"]).append_column("elements", pa.array(found, pa.list_(pa.string())))
            yield made.append_column("clean", pa.array(out, pa.string())) if cleaned else made

    return run


def _rows(docs: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, str]:
    rows = docs.select(*keys, F.col(text).alias("text_"))
    return rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text_").schema)


def find_elements(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, elements): the kinds of elements marked up in each text that has any possible mark."""
    rows, schema = _rows(docs, keys, text)
    return rows.where(_possible()).mapInArrow(_analyse(train(), False), f"{schema}, elements array<string>").where(F.size("elements") > 0)


def clean_texts(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, clean, elements) of every row."""
    rows, schema = _rows(docs, keys, text)
    marked = rows.where(_possible()).mapInArrow(_analyse(train(), True), f"{schema}, elements array<string>, clean string")
    bare = rows.where(~_possible()).select(*keys, F.array().cast("array<string>").alias("elements"), F.col("text_").alias("clean"))
    return marked.unionByName(bare)
