"""HTML to text: the one place where markup is parsed in Python, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = ("script", "style", "template", "rt", "rp")


class TextCollector(HTMLParser):
    """Text runs in document order; any tag, comment or declaration ends a run. Hidden elements are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.runs: list[str] = []
        self.open: list[str] = []
        self.hidden = 0

    def flush(self) -> None:
        text = "".join(self.open).strip()
        self.open.clear()
        if text:
            self.runs.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.flush()

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1

    def handle_comment(self, data: str) -> None:
        self.flush()

    def handle_decl(self, decl: str) -> None:
        self.flush()

    def handle_pi(self, data: str) -> None:
        self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.open.append(data)


def text_of(html: str | None) -> str:
    if not html:
        return ""
    parser = TextCollector()
    parser.feed(html)
    parser.close()
    parser.flush()
    return "\n".join(parser.runs)


def texts_of(html: pd.Series) -> pd.Series:
    return html.map(text_of)


def html_to_text(html: Column) -> Column:
    return F.pandas_udf(texts_of, "string")(html)
