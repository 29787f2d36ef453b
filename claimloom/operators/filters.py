"""Search filters as Catalyst predicates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.analyzer import analyze, analyze_text


@dataclass(frozen=True)
class Filters:
    """Constraints that must all hold; empty ones constrain nothing. None of them changes a score.

    classification_prefix is case-sensitive, of any depth; title_keyword and abstract_keyword match any of their
    analysed terms; exclude_patent keeps rows without a patent.
    """

    classification_prefix: str | None = None
    title_keyword: str | None = None
    abstract_keyword: str | None = None
    exact_title: str | None = None
    record_types: list[str] = field(default_factory=list)
    independent_only: bool = False
    exclude_patent: str | None = None
    synonyms: dict[str, str] = field(default_factory=dict)
    stem: bool = True

    def _keyword(self, column: str, keyword: str, analysed: bool) -> Column:
        """Whether a column holds a term of the keyword; of an index' rows the analysed terms are there already."""
        terms = analyze_text(keyword, self.synonyms, self.stem)
        wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
        if analysed:
            return F.arrays_overlap(F.col(f"terms_{column}"), F.transform(wanted, lambda t: F.xxhash64(t)))
        return F.arrays_overlap(analyze(F.col(column), self.synonyms, self.stem), wanted)

    def predicates(self, columns: list[str] = ()) -> list[Column]:
        """columns: those of the rows to be filtered, which may hold analysed terms."""
        out = []
        if self.classification_prefix:
            out.append(F.col("classification_raw").startswith(self.classification_prefix))
        for column, keyword in (("title", self.title_keyword), ("abstract", self.abstract_keyword)):
            if keyword:
                out.append(self._keyword(column, keyword, f"terms_{column}" in columns))
        if self.exact_title:
            out.append(F.col("title") == self.exact_title)
        if self.record_types:
            out.append(F.col("record_type").isin(list(self.record_types)))
        if self.independent_only:
            out.append(F.col("is_independent") == True)  # noqa: E712
        if self.exclude_patent:
            out.append(~F.col("patent_id").eqNullSafe(F.lit(self.exclude_patent)))
        return out

    @property
    def is_empty(self) -> bool:
        return not self.predicates()

    def apply(self, df: DataFrame) -> DataFrame:
        found = self.predicates(df.columns)
        return df.where(reduce(lambda a, b: a & b, found)) if found else df
