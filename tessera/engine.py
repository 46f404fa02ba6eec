"""The façade: requests of content and file search over a corpus, with the answers' JSON and text forms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import content, files
from tessera.plans.query import QueryError, compile_query
from tessera.plans.settings import Filters, Limit, Settings, negotiated


@dataclass(frozen=True)
class ContentRequest:
    query: str
    case_sensitive: bool = False
    path: str = ""
    include: str = ""
    exclude: str = ""
    limit: Limit | None = None
    before_after: int = 0


class Engine:
    """Searches one workspace.  ``documents`` has doc_id, rel_path, content and words; ``postings`` is optional."""

    def __init__(self, documents: DataFrame, postings: DataFrame | None = None, settings: Settings | None = None, filters: Filters | None = None):
        self.documents, self.postings, self.settings, self.filters = documents, postings, settings or Settings(), filters

    def matches(self, r: ContentRequest) -> DataFrame:
        """Flat rows, one per match, within the limits; none for a query that does not compile."""
        s = self.settings
        try:
            plan = compile_query(r.query, r.case_sensitive, s.max_wildcard_length, s.max_keyword_distance)
        except QueryError:
            return self._none(r.before_after > 0)
        wanted = content.path_filter(F.col("rel_path"), r.path, r.include, r.exclude, self.filters.include if self.filters else None)
        found = content.matches(self.documents, plan, self.postings, wanted, r.before_after)
        return content.limited(found, negotiated(s.limit, r.limit))

    def _none(self, context: bool) -> DataFrame:
        schema = f"doc_id {self.documents.schema['doc_id'].dataType.simpleString()}, rel_path string, line_number int, content string, start int, end int"
        schema += ", before array<string>, after array<string>" if context else ""
        return self.documents.sparkSession.createDataFrame([], schema + ", file_truncated boolean, truncated boolean")

    def search_content(self, r: ContentRequest) -> DataFrame:
        """One row per file, matches nested, in order of the path."""
        return content.by_file(self.matches(r), r.before_after > 0).orderBy("rel_path", "doc_id")

    def search_files(self, query: str, limit: int) -> DataFrame:
        return files.search_files(self.documents, query, limit)

    # The answers below hold at most the limits' rows and are assembled in the driver.

    def content_response(self, r: ContentRequest) -> dict:
        """``code``, ``message``, ``data`` as the JSON interface gives them."""
        if not r.query:
            return {"code": 1, "message": "Query is required"}
        results, truncated = [], False
        for row in self.search_content(r).collect():
            lines = []
            for x in row["lines"]:
                line = x["line"]
                n = line["line_number"]
                entry: dict = {"line": {"line_number": n, "content": line["content"], "match": list(line["match"])}}
                if r.before_after > 0:
                    before, after = x["before"] or [], x["after"] or []
                    if before:
                        entry["before"] = [{"line_number": n - len(before) + k, "content": t} for k, t in enumerate(before)]
                    if after:
                        entry["after"] = [{"line_number": n + 1 + k, "content": t} for k, t in enumerate(after)]
                lines.append(entry)
            one = {"file": row["rel_path"], "lines": lines}
            if row["truncate"]:
                one["truncate"] = True
            truncated = truncated or row["truncated"]
            results.append(one)
        data: dict = {"results": results} if results else {}
        if truncated:
            data["truncate"] = True
        return {"code": 0, "message": "Ok", "data": data}

    def files_response(self, query: str, limit: int) -> dict:
        if not query:
            return {"code": 1, "message": "Query is required"}
        found = [row["rel_path"] for row in self.search_files(query, limit).collect()]
        return {"code": 0, "message": "Ok", "data": {"query": query} | ({"results": found} if found else {})}

    def content_tool_text(self, query: str, path: str = "", include: str = "", exclude: str = "", limit: int = 0) -> list[str]:
        """The answer of the tool interface, a list of text lines; context of one line, case never counts."""
        r = ContentRequest(query, False, path, include, exclude, Limit(limit, self.settings.limit.max_results_per_file), 1)
        data = self.content_response(r).get("data", {})
        results = data.get("results", [])
        cut = lambda x: " (truncated)" if x else ""
        out = [f"Found {sum(len(x['lines']) for x in results)} results in {len(results)} files{cut(data.get('truncate'))}"]
        if not results:
            return [*out, "No results found."]
        for x in results:
            out += ["", "=" * 20, f"File: {x['file']}, {len(x['lines'])} result{cut(x.get('truncate'))}"]
            for m in x["lines"]:
                out.append("-" * 20)
                out += [f"Line {t['line_number']}: {t['content']}" for t in (*m.get("before", []), m["line"], *m.get("after", []))]
        return out

    def files_tool_text(self, query: str, limit: int | None = None) -> list[str]:
        most = self.settings.client_limit.max_files_results if limit is None else limit
        found = self.files_response(query, min(most, self.settings.limit.max_files_results)).get("data", {}).get("results", [])
        return [f"Found {len(found)} files.", *(found or ["No results found."])]

    def content_console_text(self, r: ContentRequest) -> str:
        """The listing of the command line."""
        data = self.content_response(r).get("data", {})
        results = data.get("results", [])
        if not results:
            return "No results found."
        rule = "-" * 40
        out = [f"Found {sum(len(x['lines']) for x in results)} results in {len(results)} files:", rule]
        for x in results:
            out.append(f"File: {x['file']}")
            out += [f"→ {m['line']['line_number']:4d}@({m['line']['match'][0]},{m['line']['match'][1]}): {m['line']['content']}" for m in x["lines"]]
            out += ["  (Results truncated...)"] * bool(x.get("truncate")) + [rule]
        return "\n".join(out + ["(Search results were truncated. Try narrowing your search.)"] * bool(data.get("truncate")))

    def files_console_text(self, query: str, limit: int) -> str:
        found = self.files_response(query, limit).get("data", {}).get("results", [])
        return "\n".join([f"Found {len(found)} files:", "-" * 40, *(f"File: {f}" for f in found)]) if found else "No results found."
