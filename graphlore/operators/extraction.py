"""The extraction seam: one article in, its entities, relations and facts out, as a table function over a partitioned table.

An extractor is any object with ``extract(article)``, given a dict of title
and text and giving a dict of ``entities`` (name, type, description),
``relationships`` (source, target, relation, context) and ``key_facts``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

FOUND = "article string, kind string, name string, source string, target string, relation string, detail string"


def extracted(sections: DataFrame, make: Callable[[], object]) -> DataFrame:
    """article, kind (entity, relation, fact or error) and what was found, of sections (article, section_index, content).

    ``make`` gives the extractor, on the executor, once for each article; one
    with ``close`` is closed after it. The
    sections of an article reach it in order, as one text, in one call. An
    article at which it fails has one row, of kind error, and stops no other.
    Null contents count as empty; a null title is an article like others.
    """

    @F.udtf(returnType=FOUND)
    class Extract:
        def __init__(self) -> None:
            self.title, self.parts = None, []

        def eval(self, row: Row) -> None:
            self.title = row["article"]
            self.parts.append(row["content"] or "")

        def terminate(self) -> Iterator[tuple]:
            def text(x, name: str) -> str | None:
                return None if x.get(name) is None else str(x[name])

            try:
                extractor = make()
                try:
                    got = extractor.extract({"title": self.title, "text": "\n\n".join(self.parts)})
                finally:
                    if hasattr(extractor, "close"):
                        extractor.close()
                rows = [(self.title, "entity", text(e, "name"), None, None, text(e, "type"), text(e, "description")) for e in got.get("entities", [])]
                rows += [(self.title, "relation", None, text(r, "source"), text(r, "target"), text(r, "relation"), text(r, "context")) for r in got.get("relationships", [])]
                rows += [(self.title, "fact", None, None, None, None, str(f)) for f in got.get("key_facts", [])]
            except Exception as e:  # the article is skipped, with its reason
                rows = [(self.title, "error", None, None, None, None, f"{type(e).__name__}: {e}"[:500])]
            yield from rows

    table = sections.select("article", "section_index", "content").asTable().partitionBy("article").orderBy("section_index")
    return Extract(table)
