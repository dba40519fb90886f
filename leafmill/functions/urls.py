"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Fixed value: hosts of the video site's pages.
VIDEO_HOST = r"(?i)^(?:www\.|m\.)?youtube\.com$"


def document_id(url: Column | str) -> Column:
    """The first 24 hexadecimal digits of the SHA-256 of the URL."""
    return F.substring(F.sha2(col(url), 256), 1, 24)


def host(url: Column | str) -> Column:
    return F.lower(F.try_parse_url(col(url), F.lit("HOST")))


def path(url: Column | str) -> Column:
    return F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit(""))


def host_label(url: Column | str) -> Column:
    """The host, "Local file" for a URL without one, and the text itself if it is no URL."""
    u = col(url)
    return F.when(F.coalesce(host(u), F.lit("")) != "", host(u)).when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "Local file").otherwise(u)


def points_to_pdf(url: Column | str, content_type: Column | None = None) -> Column:
    """By the path's ending, the path of a paper archive, or the content type that the caller supplies."""
    u = col(url)
    found = u.rlike(r"(?i)\.pdf(?:$|[?#])") | (F.coalesce(host(u).rlike(r"^(?:www\.)?arxiv\.org$"), F.lit(False)) & path(u).rlike(r"(?i)^/pdf/[^/]+/?$"))
    return found if content_type is None else found | F.coalesce(content_type.rlike("(?i)application/pdf"), F.lit(False))


def _first_segment(p: Column) -> Column:
    return F.regexp_extract(p, r"^/*([^/]+)", 1)


def video_id(url: Column | str) -> Column:
    """The id of a video page: any v of /watch, eleven characters after /shorts, /live or /embed, or a short link's first segment."""
    u = col(url)
    h, p = F.coalesce(host(u), F.lit("")), path(u)
    watch = F.when(p == "/watch", F.coalesce(F.try_parse_url(u, F.lit("QUERY"), F.lit("v")), F.lit(""))).otherwise(F.regexp_extract(p, r"(?i)^/(?:shorts|live|embed)/([\w-]{11})", 1))
    return F.when(h.rlike(VIDEO_HOST), watch).when(h.rlike(r"^youtu\.be$"), _first_segment(p)).otherwise(F.lit(""))


def saved_video_id(url: Column | str) -> Column:
    """The laxer form used for saved documents: v of any path, or any segment after /shorts or /embed."""
    u = col(url)
    h, p = F.coalesce(host(u), F.lit("")), path(u)
    v = F.nullif(F.coalesce(F.try_parse_url(u, F.lit("QUERY"), F.lit("v")), F.lit("")), F.lit(""))
    return F.when(h == "youtu.be", _first_segment(p)).when(h.rlike(VIDEO_HOST), F.coalesce(v, F.regexp_extract(p, r"^/(?:shorts|embed)/([^/?#]+)", 1))).otherwise(F.lit(""))


def route(url: Column | str, content_type: Column | None = None) -> Column:
    """Where an address goes: library, video, pdf or article."""
    u = col(url)
    return F.when(~F.coalesce(u.rlike(r"(?i)^(https?|file)://"), F.lit(False)), "library").when(video_id(u) != "", "video").when(points_to_pdf(u, content_type), "pdf").otherwise("article")


def title_of(title: Column, url: Column | str) -> Column:
    """The title, else the decoded last path segment or the host, without .pdf, else a constant."""
    u = col(url)
    last = F.regexp_extract(path(u), r"([^/]*)$", 1)
    name = F.regexp_replace(F.coalesce(F.nullif(F.try_url_decode(last), F.lit("")), host(u)), r"(?i)\.pdf$", "")
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(name, F.lit("")), F.lit("Saved document"))


def kind_label(kind: Column | str) -> Column:
    return F.when(col(kind) == "pdf", "PDF").when(col(kind) == "youtube", "YouTube").otherwise("Article")
