"""Scalar functions over the notes model. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Opens a conflict in a merged text; the other two lines part and close it.
CONFLICT_OPEN, CONFLICT_MID, CONFLICT_CLOSE = "<<<<<<< edited", "=======", ">>>>>>> reanalyzed"


def no_strings() -> Column:
    return F.array().cast("array<string>")


def note_name(source: Column, file_id: Column) -> Column:
    """The source without one trailing ``.note``; the file id if nothing is left."""
    bare = F.regexp_replace(F.coalesce(source, F.lit("")), r"\.note\z", "")
    return F.when(bare == "", file_id).otherwise(bare)


def _digits(id_: Column) -> Column:
    return F.regexp_extract(F.coalesce(id_, F.lit("")), r"\A[PF]?([0-9]*)", 1)


def created_at(id_: Column) -> Column:
    """The time an id carries: 14 leading digits, else 8 at midnight, else none."""
    digits = _digits(id_)
    n = F.length(digits)
    full = F.when(n >= 14, F.try_to_timestamp(F.substring(digits, 1, 14), F.lit("yyyyMMddHHmmss")))
    day = F.when(n >= 8, F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd")))
    return F.coalesce(full, day)


def effective_tags(note_tags: Column, page_tags: Column) -> Column:
    """The sorted union of a note's and a page's tags."""
    return F.array_sort(F.array_union(F.coalesce(note_tags, no_strings()), F.coalesce(page_tags, no_strings())))


def denote_id(value: Column) -> Column:
    """``YYYYMMDDTHHMMSS`` from an id, or from a file name that carries such an identifier; else empty."""
    digits = _digits(value)
    of_id = F.when(F.length(digits) >= 14, F.concat(F.substring(digits, 1, 8), F.lit("T"), F.substring(digits, 9, 6)))
    stop = r"(?:\z|==|--|__|@@|\.)"
    text = F.coalesce(value, F.lit(""))
    leading = F.regexp_extract(text, r"\A([0-9]{8}T[0-9]{6})" + stop, 1)
    inner = F.regexp_extract(text, r"@@([0-9]{8}T[0-9]{6})" + stop, 1)
    return F.coalesce(of_id, F.when(leading != "", leading).otherwise(inner))


def vector_path(file_id: Column, page_id: Column) -> Column:
    return F.concat(file_id, F.lit("/"), page_id, F.lit(".svg"))


def norm_text(text: Column) -> Column:
    """The stored form: one newline at the end, or nothing at all."""
    bare = F.rtrim(F.coalesce(text, F.lit("")), F.lit("\n"))
    return F.when(bare == "", "").otherwise(F.concat(bare, F.lit("\n")))


def link_facts(links: Column, file_id: Column) -> Column:
    """links with ``internal``: the target's file id is the note's, whatever the kind."""
    return F.transform(links, lambda l: l.withField("internal", F.coalesce(l["target_file_id"], F.lit("")) == file_id))


def link_label(link: Column) -> Column:
    """The analysed name, else the device's; links to notes lose every ``.note`` in it."""
    analysed = link["analysis"]["name"]
    label = F.coalesce(F.when(analysed != "", analysed), link["name"], F.lit(""))
    to_page = F.coalesce(link["target_page_id"], F.lit("")) != ""
    return F.when(to_page, F.replace(label, F.lit(".note"), F.lit(""))).otherwise(label)


def nest_headings(text: Column, prefix: str) -> Column:
    """Puts prefix before each line that starts with its character; prefix repeats one character."""
    if not prefix or prefix.strip(prefix[0]):
        raise ValueError(f"prefix must repeat one heading character, got {prefix!r}")
    mark = prefix[0]
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.when(line.startswith(mark), F.concat(F.lit(prefix), line)).otherwise(line)), "\n")


def has_conflicts(text: Column) -> Column:
    return F.coalesce(text.contains(CONFLICT_OPEN), F.lit(False))


def note_tag_line(keywords: Column) -> Column:
    """Keywords as one tag line; characters that tags cannot hold become ``_``. Null without keywords."""
    tags = F.transform(keywords, lambda k: F.regexp_replace(k, r"[^\p{L}\p{N}_@#%]", "_"))
    return F.when(F.size(keywords) > 0, F.concat(F.lit("#+filetags: :"), F.array_join(tags, ":"), F.lit(":\n")))


def background_bytes(svg: Column) -> Column:
    """The decoded image that a vector carries inline; null if there is none or it is malformed."""
    uri = F.regexp_extract(F.coalesce(svg, F.lit("")), r'xlink:href="(data:image/[^"]*)"', 1)
    data = F.regexp_extract(uri, r"\Adata:image/[^;,]*;[^,]*,(.*)\z", 1)
    sound = data.rlike(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    return F.when((uri != "") & uri.rlike(r"\Adata:image/[^;,]*;[^,]*,") & sound, F.try_to_binary(data, F.lit("base64")))


def background_hash(svg: Column) -> Column:
    return F.sha2(background_bytes(svg), 256)


def page_content(md: Column, templated: Column, analysis: Column | None = None, n_regions: Column | None = None) -> Column:
    """What a reader sees: the text without newlines at its end; empty for a templated page.

    With analysis and n_regions given, null where there is nothing at all to show.
    """
    content = F.when(templated, F.lit("")).otherwise(F.rtrim(F.coalesce(md, F.lit("")), F.lit("\n")))
    if analysis is None:
        return content
    shown = analysis.isNotNull() | (F.when(templated, F.lit("")).otherwise(F.coalesce(md, F.lit(""))) != "") | (F.coalesce(n_regions, F.lit(0)) > 0)
    return F.when(shown, content)


def path_strokes(svg: Column) -> Column:
    """The strokes of a vector: runs of path tokens from one moveto to the next, blanks made even."""
    elements = F.regexp_extract_all(F.coalesce(svg, F.lit("")), F.lit(r"(?s)(<path.*?/>)"), 1)
    data = F.transform(elements, lambda e: F.trim(F.regexp_replace(F.regexp_extract(e, r'(?s)\bd="([^"]*)"', 1), r"[ \t\n]+", " ")))
    strokes = F.flatten(F.transform(data, lambda d: F.split(d, r" (?=[Mm](?: |\z))")))
    return F.filter(strokes, lambda s: s != "")


def handwriting(svg: Column) -> Column:
    """A fingerprint of the drawn paths that restyling does not move."""
    return F.sha2(F.array_join(path_strokes(svg), "\n"), 256)


def apply_tag(tags: Column, tag: str, remove: bool = False) -> Column:
    """tags with tag added or removed, sorted and distinct."""
    now = F.coalesce(tags, no_strings())
    return F.array_sort(F.array_distinct(F.array_remove(now, tag) if remove else F.array_union(now, F.array(F.lit(tag)))))


def text_change(was: Column, now: Column) -> Column:
    """kind (unchanged, cleared, new, updated), conflicts, was and now, both in the stored form."""
    w, n = norm_text(was), norm_text(now)
    kind = F.when(w == n, "unchanged").when(n == "", "cleared").when(w == "", "new").otherwise("updated")
    return F.struct(kind.alias("kind"), has_conflicts(n).alias("conflicts"), w.alias("was"), n.alias("now"))


def edit_change(was: Column, now: Column, base: Column) -> Column:
    """text_change, but ``reverted`` when a change leads back to a base that is not empty."""
    change, b = text_change(was, now), norm_text(base)
    back = (change["kind"] != "unchanged") & (b != "") & (change["now"] == b)
    return change.withField("kind", F.when(back, F.lit("reverted")).otherwise(change["kind"]))


def device_hash(*parts: Column) -> Column:
    """A fingerprint of what the device decided about a page: scalars, or structs written as JSON."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
