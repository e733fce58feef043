"""Fields of scraped pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_fields(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with title, site and n_links."""
    return pages.withColumns(
        {
            "title": F.trim(F.regexp_extract(html, r"<title>([^<]*)</title>", 1)),
            "site": F.regexp_extract(url, r"^https?://([^/:?#]+)", 1),
            "n_links": F.size(F.regexp_extract_all(html, F.lit(r"<a\s[^>]*href="), F.lit(0))).cast("long"),
        }
    )
