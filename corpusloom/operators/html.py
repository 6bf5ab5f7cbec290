"""Questions, related documents, law metadata and contents out of HTML pages."""
from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    def __init__(self, tag: str, attributes: dict, parent: "Node | None"):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children if isinstance(c, str) or c.tag not in ("script", "style"))

    def find_all(self, tag: str):
        for c in self.children:
            if not isinstance(c, str):
                if c.tag == tag:
                    yield c
                yield from c.find_all(tag)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.at.tag == "p":
            self.at = self.at.parent
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _plain(text: str) -> str:
    return text.replace("\n", " ").strip()


def qa_pairs(html: str | None) -> list[dict]:
    """Each h2 with the links of the paragraphs that follow it among its siblings, without those that later headings claim.

    The links behind a heading include those behind the headings after it, so from the last heading on each keeps
    as many fewer, from the end of its list, as the later ones have kept.  Links lose the parameter behind ``&mode``.
    """
    found, claimed = [], 0
    for heading in reversed(list(parse(html or "").find_all("h2"))):
        siblings = heading.parent.children
        behind = [n for n in siblings[siblings.index(heading) + 1 :] if not isinstance(n, str) and n.tag == "p"]
        links = [{"title": _plain(a.text()), "href": _without_mode(a.attributes.get("href"))} for p in behind for a in p.find_all("a")]
        kept = links[: max(len(links) - claimed, 0)]
        claimed += len(kept)
        found.append({"question": _plain(heading.text()), "rel_docs": kept})
    return found[::-1]


def _without_mode(href: str | None) -> str | None:
    return None if href is None else href.partition("&mode")[0]


def law_page(url: str | None, html: str | None) -> dict | None:
    """Metadata cells, status and content of a law page; none without a chapter or article anchor."""
    root = parse(html or "")
    anchors = {a.attributes.get("name"): a for a in root.find_all("a") if a.attributes.get("name")}
    anchor = anchors.get("chuong_1") or anchors.get("dieu_1")
    if anchor is None:
        return None
    rows = [[_plain(c.text()) for c in r.children if not isinstance(c, str) and c.tag in ("td", "th")] for t in list(root.find_all("table"))[:1] for r in t.find_all("tr")]

    def cell(row: int, column: int):
        return rows[row - 1][column - 1] if len(rows) >= row and len(rows[row - 1]) >= column else None

    status = next((_plain(s.text()) for s in root.find_all("span") if "status" in (s.attributes.get("class") or "")), None)
    start = anchor if anchor.tag == "p" or anchor.parent is None else anchor.parent if anchor.parent.tag == "p" else anchor
    siblings = start.parent.children
    content = [_plain(start.text())] + [_plain(n.text()) for n in siblings[siblings.index(start) + 1 :] if not isinstance(n, str) and n.tag == "p"]
    title = next((_plain(h.text()) for h in root.find_all("h1")), None)
    number = re.search(r"([^-]*)$", url or "")
    return {
        "id": number[1].split(".")[0] if number else None, "title": title, "href": url, "so_hieu": cell(1, 2), "loai_van_ban": cell(2, 2), "noi_ban_hanh": cell(1, 5),
        "tinh_trang": status, "content": content,
    }


QA_TYPE = "array<struct<question:string,rel_docs:array<struct<title:string,href:string>>>>"
LAW_TYPE = "id string, title string, href string, so_hieu string, loai_van_ban string, noi_ban_hanh string, tinh_trang string, content array<string>"


def extract_qa(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(url, qa_pairs)``; a null page has none."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"url": frame["url"], "qa_pairs": [qa_pairs(h) for h in frame["html"]]})

    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, f"url string, qa_pairs {QA_TYPE}")


def extract_laws(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row per law page that has contents."""

    def run(frames):
        for frame in frames:
            rows = [law_page(u, h) for u, h in zip(frame["url"], frame["html"])]
            yield pd.DataFrame([r for r in rows if r is not None], columns=[p.split(" ")[0] for p in LAW_TYPE.split(", ")])

    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, LAW_TYPE)


def page_links(pages: DataFrame, html: str = "html", key: str = "url") -> DataFrame:
    """``(key, at, href)``: link targets in the order of the page, by pattern."""
    links = F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), 1)
    return pages.select(key, F.posexplode(links).alias("at", "href"))


def list_pages(links: DataFrame, href: str = "href", title: str | None = None) -> DataFrame:
    """Absolute links whose title does not speak of a circular."""
    kept = links.where(F.col(href).startswith("https:"))
    return kept.where(~F.col(title).contains("Circular")) if title else kept
