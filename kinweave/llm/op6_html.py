"""HTML extraction with wrappers inferred from the pages of a host.

A page is a stream of block-level tags and texts. Texts of one kind that follow each other in the same element are a run.
A page's own union-free regular expression is made by folding neighbouring repeats of runs into groups; it keeps its texts.
Expressions of one host are aligned, one after the other: what both have stays, a part that only one has becomes optional,
a part repeated in one becomes repeated. Texts that agree place by place on all pages are constants, texts that differ are
slots, and so are all texts of a run or group whose number of repeats differs. The result is the wrapper of the host.

Every page is then aligned to the wrapper of its host and read part by part. Constants that LEAST_PAGES different pages share
belong to the template and are no text of a page. Parts that HTML itself names as beside the text (nav, footer and the like)
are left out. A part whose class, id or role has a word such as 'sidebar' is left out only where the wrapper's slots allow it:
a part that holds half of the host's main parts, else of its titles, else of all its slots, is the text whatever its name.
Where a page has text in an article or main part, only slots inside it count.
"""

from __future__ import annotations

import html
import json
import re
from difflib import SequenceMatcher
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, pa_schema, small_batches, stage, table

#: Names of tags.
HIDDEN = set("script style noscript template iframe svg math textarea title head object canvas button select datalist".split())
RAW = {"script", "style", "textarea", "title"}
BLOCKS = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "nav header footer aside form fieldset legend address hr details summary menu dialog search center".split()
)
ASIDE = {"nav", "header", "footer", "aside", "menu", "dialog", "search"}
MAIN = {"article", "main"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CELL_ENDS = {"td", "th", "tr", "tbody", "tfoot"}
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": CELL_ENDS, "th": CELL_ENDS}
#: Words in a class, id or role that mark parts beside the main text. Reader comments, adverts and consent
#: can outweigh a short article, so their weight alone never makes them the text.
FOREIGN = set("ad ads advert advertisement adverts sponsor sponsored cookie cookies consent popup comment comments reply replies respond discussion discussions disqus newsletter".split())
#: Of these, words that may also name a remark inside a sentence: they mute no inline text.
REMARKS = set("comment comments reply replies respond discussion discussions".split())
BESIDE = set("promo banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside header footer notice notices modal related share sharing social subscribe signup login toolbar widget".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: So many different pages must share a text before it is a constant: two may be copies of each other.
LEAST_PAGES = 3
#: Texts and parts that a task holds before it hands its wrappers on.
HELD = 200_000


def words_of(attributes: str) -> set[str]:
    """The words of a tag's class, id and role."""
    found = (m[1] or m[2] or m[3] or "" for m in NAMED.finditer(attributes))
    return {w for text in found for w in re.split(r"[^a-z]+", text.lower())}


def label(tag: str, attributes: str, in_main: bool) -> str:
    """A block tag's name, with a mark: '!' for tags of parts beside the text, '#' and '?' for names with a word of FOREIGN or BESIDE.

    A form may be the frame of a whole page, and a header inside an article may hold its title, so these are '?'.
    """
    if tag in ("html", "body"):
        return tag
    words = words_of(attributes) if attributes else set()
    if not FOREIGN.isdisjoint(words):
        return tag + "#"
    if tag in ASIDE and not (tag == "header" and in_main):
        return tag + "!"
    return tag + "?" if tag in ("form", "header") or not BESIDE.isdisjoint(words) else tag


class Blocks:
    """Reads a page into blocks: (path, text, parent, weight) in order.

    A path lists the labels of the open block tags; parent is the number of the element around the innermost one, so that
    equal numbers mean the same element; weight is the length of the text that is not in a link, as it stands in the markup.
    Inline tags do not end a block. Those of HIDDEN, and those named by a word of FOREIGN but REMARKS, mute the text up to their end.
    """

    def __init__(self, page: str):
        self.page, self.out, self.stack, self.text = page, [], [], []
        self.opened, self.link, self.linked = 0, False, 0
        self.mute: list[tuple[str, int]] = []  # open muting tags, and how many blocks were open then

    def blocks(self) -> list[tuple[str, str, int, int]]:
        page, at = self.page, 0
        while at < len(page):
            m = TOKEN.search(page, at)
            if m is None:
                self._words(page[at:])
                break
            if m.start() > at:
                self._words(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
            else:
                self._open(tag, m[3] or "")
                if tag in RAW and not (m[3] or "").endswith("/"):
                    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
        self._flush()
        return self.out

    def _words(self, text: str) -> None:
        if not self.mute:
            self.text.append(text)
            if self.link:
                self.linked += len(text)

    def _flush(self) -> None:
        if self.text:
            whole = "".join(self.text)
            words = html.unescape(whole).split()
            self.text.clear()
            if words:
                parent = self.stack[-2][2] if len(self.stack) > 1 else 0
                self.out.append(("/".join(x[1] for x in self.stack), " ".join(words), parent, max(0, len(whole) - self.linked)))
        self.link, self.linked = False, 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._words(" ")
        elif tag == "a":
            self.link = True
        if tag in RAW or (tag in VOID and tag != "hr"):
            return
        alone = attributes.endswith("/")
        if tag not in BLOCKS:
            if not alone and (tag in HIDDEN or (attributes and not (FOREIGN - REMARKS).isdisjoint(words_of(attributes)))):
                self.mute.append((tag, len(self.stack)))
            elif self.mute and not alone and any(tag == x for x, _ in self.mute):
                self.mute.append((tag, len(self.stack)))  # the same tag again, so that its end is told from the outer one's
            return
        self._flush()
        if tag == "body":
            self.mute.clear()
        while self.stack and tag in CLOSED_BY.get(self.stack[-1][0], ()):
            self._pop(len(self.stack) - 1)
        if tag != "hr" and not alone:
            self.opened += 1
            in_main = any(x[0] in MAIN for x in self.stack)
            self.stack.append((tag, label(tag, attributes, in_main), self.opened))

    def _close(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        if tag in BLOCKS:
            self._flush()
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == tag:
                    self._pop(k)
                    break
            return
        for k in range(len(self.mute) - 1, -1, -1):
            if self.mute[k][0] == tag:
                del self.mute[k:]
                break

    def _pop(self, to: int) -> None:
        """Closes blocks down to a depth; muting tags that were left open in them end with them."""
        del self.stack[to:]
        self.mute = [x for x in self.mute if x[1] <= to]


def slots(page: str | None) -> list[tuple[str, str, int, int]]:
    return Blocks(page or "").blocks()


def runs_of(page: str | None) -> list[list]:
    """Runs [path, parent, texts, weight] of a page."""
    runs: list = []
    for path, text, parent, weight in slots(page):
        if runs and runs[-1][0] == path and runs[-1][1] == parent:
            runs[-1][2].append(text)
            runs[-1][3] += weight
        else:
            runs.append([path, parent, [text], weight])
    return runs


def gaps(items: list) -> list[int]:
    """Distances between neighbouring equal items, the periods that a repeat can have, shortest first."""
    last, found = {}, set()
    for i, x in enumerate(items):
        key = json.dumps(x)
        if key in last:
            found.add(i - last[key])
        last[key] = i
    return sorted(found)


def fold(items: list) -> list[tuple]:
    """Neighbouring repeats become one repeated group: [items] for a group, a path for a run; and for each the number of runs it stands for."""
    sizes, widths = [1] * len(items), gaps(items)
    while widths:
        width = widths.pop(0)
        out, counts, i, folded = [], [], 0, False
        while i < len(items):
            part, j = items[i : i + width], i + width
            if j < len(items) and items[j] == items[i]:
                while len(part) == width and items[j : j + width] == part:
                    j += width
            if j > i + width:
                out.append(part[0] if width == 1 and isinstance(part[0], list) else [part])
                folded = True
            else:
                out.append(items[i])
                j = i + 1
            counts.append(sum(sizes[i:j]))
            i = j
        if folded:
            items, sizes = out, counts
            widths = gaps(items)
    return list(zip(items, sizes, strict=True))


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


def parts_of(runs: list[list]) -> list[tuple[str, bool, list[list]]]:
    """A page's expression: (content, whether repeated, its runs) for each part; content is the JSON of its paths and groups."""
    out, at = [], 0
    for x, size in fold([r[0] for r in runs]):
        own = runs[at : at + size]
        at += size
        out.append((json.dumps(x[0] if isinstance(x, list) else [x]), isinstance(x, list) or len(own[0][2]) > 1, own))
    return out


def expression(page: str | None) -> list[dict]:
    """A page's expression as a wrapper of one page: parts with

    content, repeated, optional; texts: each run's path and text digests in order, 0 for a slot, None for a run (or for the whole
    part) whose number of repeats differs; pages: digests of a few of the pages that it is from; mass: weight of text by path.
    """
    runs = runs_of(page)
    name, out = digest(json.dumps([[r[0], r[2]] for r in runs])), []
    for content, repeated, own in parts_of(runs):
        mass: dict[str, int] = {}
        for path, _, _, weight in own:
            mass[path] = mass.get(path, 0) + weight
        out.append({"content": content, "repeated": repeated, "optional": False, "texts": [[r[0], [digest(t) for t in r[2]]] for r in own], "pages": [name], "mass": mass})
    return out


def met(a: list | None, b: list | None) -> list | None:
    """Texts of two parts place by place; None, where all is slots, if one is None or the runs differ in number or path."""
    if a == b or a is None:
        return a
    if b is None or [x[0] for x in a] != [y[0] for y in b]:
        return None
    return [[x[0], met_texts(x[1], y[1])] for x, y in zip(a, b, strict=True)]


def met_texts(a: list | None, b: list | None) -> list | None:
    if a == b:
        return a
    return [x if x == y else 0 for x, y in zip(a, b, strict=True)] if a is not None and b is not None and len(a) == len(b) else None


def both(a: dict, b: dict, texts: list | None, **more) -> dict:
    """One part from two of the same content."""
    mass = dict(a["mass"])
    for path, weight in b["mass"].items():
        mass[path] = mass.get(path, 0) + weight
    own = {"repeated": a["repeated"] or b["repeated"], "optional": a["optional"] or b["optional"], "pages": sorted({*a["pages"], *b["pages"]})[:LEAST_PAGES]}
    return {"content": a["content"], "texts": texts, "mass": mass, **own, **more}


def same_places(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places, rising on both sides, with equal contents."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    return [(x.a + k, x.b + k) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for k in range(x.size)]


def align(a: list[dict], b: list[dict]) -> list[dict]:
    """Two expressions into one that covers both."""
    out, i, j = [], 0, 0
    for p, q in [*same_places([x["content"] for x in a], [x["content"] for x in b]), (len(a), len(b))]:
        out += [x | {"optional": True} for x in (*a[i:p], *b[j:q])]
        if p < len(a):
            out.append(both(a[p], b[q], met(a[p]["texts"], b[q]["texts"])))
        i, j = p + 1, q + 1
    return squeeze(out)


def squeeze(items: list[dict]) -> list[dict]:
    """An optional part that stands elsewhere too is a repeat of it, whose number of repeats differs.

    So a wrapper has no more parts than its shortest page and the number of different contents together, whatever the number of pages.
    """
    out: list[dict] = []
    at: dict[str, int] = {}
    for x in items:
        k = at.get(x["content"])
        if k is not None and (x["optional"] or out[k]["optional"]):
            out[k] = both(out[k], x, None, repeated=True, optional=out[k]["optional"] and x["optional"])
        else:
            at[x["content"]] = len(out)
            out.append(x)
    return out


def paths_in(content) -> list[str]:
    return [content] if isinstance(content, str) else [p for x in content for p in paths_in(x)]


def is_constant(part: dict) -> bool:
    """Whether all texts of a part are constants."""
    return len(part["pages"]) >= LEAST_PAGES and part["texts"] is not None and all(texts is not None and 0 not in texts for _, texts in part["texts"])


def in_main(path: str) -> bool:
    """Whether a path leads through an article or main part that does not lie in a part with a foreign name: articles there are comments."""
    for x in path.split("/"):
        if x.endswith("#"):
            return False
        if x.rstrip("?") in MAIN:
            return True
    return False


def in_any_main(path: str) -> bool:
    """in_main, for hosts all of whose articles lie in parts with a foreign name, as of a frame."""
    return any(x.rstrip("?#") in MAIN for x in path.split("/"))


def doubtful(path: str) -> list[str]:
    """The beginnings of a path that end in a label with '?' or '#'."""
    parts = path.split("/")
    return ["/".join(parts[: i + 1]) for i, x in enumerate(parts) if x[-1:] in ("?", "#")]


def content_paths(wrapper: list[dict]) -> list[str]:
    """The paths of the slots of a wrapper that hold main text."""
    paths = sorted({p for part in wrapper for p in paths_in(json.loads(part["content"]))})
    weights: dict[str, int] = {}
    for part in wrapper:
        if not is_constant(part):
            for path, weight in part["mass"].items():
                if "!" not in path:
                    weights[path] = weights.get(path, 0) + weight
    kinds = {"main": in_main, "any main": in_any_main, "title": lambda p: p.split("/")[-1] == "h1", "all": lambda p: True}
    share: dict[str, dict[str, int]] = {}  # of each kind, by the beginning of a path; all of it under ""
    for kind, fits in kinds.items():
        share[kind] = {"": 0}
        for path, weight in weights.items():
            if fits(path):
                for head in ("", *doubtful(path)):
                    share[kind][head] = share[kind].get(head, 0) + weight

    def is_text(head: str) -> bool:
        kind = next((k for k in kinds if share[k][""] > 0), None)
        return kind is not None and (kind != "all" or not head.endswith("#")) and 2 * share[kind].get(head, 0) >= share[kind][""]

    return [p for p in paths if "!" not in p and all(map(is_text, doubtful(p)))]


def reader(wrapper: list[dict]) -> dict:
    """What pages are read by: paths of main text, and the parts of the wrapper with their constants, if it has any.

    What stands in an article or main part is its text, however many pages share it: headings recur, and pages may be copies of one
    article. So constants are taken out of other parts alone.
    """
    kept = set(content_paths(wrapper))

    def constants(part: dict) -> list | None:
        if len(part["pages"]) < LEAST_PAGES or part["texts"] is None:
            return None
        own = [[] if texts is None or in_any_main(path) else texts for path, texts in part["texts"]]
        return own if any(any(x) for x in own) else None

    parts = [[x["content"], constants(x)] for x in wrapper]
    return {"paths": sorted(kept), "parts": parts if any(c for _, c in parts) else []}


def read(page: str | None, rules: dict) -> str:
    """The text of a page, aligned to the wrapper of its host."""
    runs = runs_of(page)
    paths, fixed = set(rules["paths"]), rules["parts"]
    varying = [(r[0], t) for r in runs for t in r[2] if r[0] in paths]
    if fixed:
        own = parts_of(runs)
        matched = dict(same_places([x[0] for x in own], [x[0] for x in fixed]))
        first: dict[str, int] = {}
        for k, (content, _) in enumerate(fixed):
            first.setdefault(content, k)
        left = []
        for i, (content, _, part) in enumerate(own):
            k = matched.get(i, first.get(content))
            same = (fixed[k][1] if k is not None else None) or [[]] * len(part)
            for run, texts in zip(part, same if len(same) == len(part) else [[]] * len(part), strict=True):
                if run[0] in paths:
                    left += [(run[0], t) for j, t in enumerate(run[2]) if not (len(texts) == len(run[2]) and texts[j] == digest(t))]
        varying = left or varying
    return main_text(varying)


def main_text(found: list[tuple[str, str]]) -> str:
    """The text of a page from its (path, text) of slots: those in an article or main part where this page has them, else all."""
    inside = [t for p, t in found if in_main(p)] or [t for p, t in found if in_any_main(p)]
    return "\n".join(inside or [t for _, t in found])


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def aligned(kinds: dict[str, list]) -> list:
    """The expressions of a host, by the order of their parts, as one."""
    total = None
    for key in sorted(kinds):
        total = kinds[key] if total is None else align(total, kinds[key])
    return total or []


def wrappers(pages: DataFrame) -> DataFrame:
    """pages (url, html) to host, wrapper (JSON): every page of a host is aligned.

    Tasks align what they read, then groups of tasks, then hosts, so a host with a third of all pages is shared out. A task hands
    its wrappers on when they hold HELD texts and parts.
    """
    spark = pages.sparkSession
    small_batches(spark)
    ddl = "host string, salt int, wrapper string"
    out = pa_schema(spark, ddl)

    def first(batches):
        from pyspark import TaskContext

        found: dict[str, dict[str, list]] = {}  # by host and the order of its parts
        salt = TaskContext.get().partitionId() % 64

        def rows():
            made = [json.dumps(aligned(kinds)) for kinds in found.values()]
            out_rows = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([salt] * len(found), pa.int32()), pa.array(made, pa.string())], schema=out)
            found.clear()
            return out_rows

        size = 0
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = expression(page)
                kinds, key = found.setdefault(host, {}), json.dumps([x["content"] for x in own])
                if key in kinds:
                    own = align(kinds[key], own)
                else:
                    size += sum(1 + sum(len(t) for _, t in x["texts"]) for x in own)
                kinds[key] = own
                if size > HELD:
                    yield rows()
                    size = 0
        yield rows()

    def merged(rows: pa.Table) -> pa.Table:
        total = None
        for w in sorted(set(rows["wrapper"].to_pylist())):
            total = json.loads(w) if total is None else align(total, json.loads(w))
        return pa.table([rows["host"][:1], rows["salt"][:1], pa.array([json.dumps(total)])], schema=out)

    parts = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(first, ddl)
    grouped = parts.groupBy("host", "salt").applyInArrow(merged, ddl)
    return grouped.groupBy("host").applyInArrow(merged, ddl).select("host", "wrapper")


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) to page_id, url, text, n_chars; one row for every input row.

    A null or empty page has an empty text. Pages without a readable host are one host of their own. Repeated rows are
    read each. Broken markup is read as far as it goes; nothing is cut off. Other columns are not read. An empty table gives none.
    """

    def chosen(batch: pa.RecordBatch) -> dict:
        return {"host": batch.column(0), "rules": [json.dumps(reader(json.loads(w))) for w in batch.column(1).to_pylist()]}

    rules = stage(map_batches(wrappers(pages), chosen, "host string, rules string"), "html-wrappers")
    hosted = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def each(batch: pa.RecordBatch) -> dict:
        known: dict[str, dict] = {}
        texts = []
        for page, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if own not in known:
                known[own] = json.loads(own)
            texts.append(read(page, known[own]))
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    joined = hosted.join(rules, "host").select("page_id", "url", "html", "rules")
    return map_batches(joined, each, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
