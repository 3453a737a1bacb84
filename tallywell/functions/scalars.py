"""Scalar and array functions of the document service, as columns. No Python runs on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywell.functions.expr import let

# Other names of tools.
ALIASES = {"ppt-to-pdf": "powerpoint-to-pdf", "pdf-to-ppt": "pdf-to-powerpoint", "pdf-to-img": "pdf-to-image", "img-to-pdf": "image-to-pdf"}

# The service that runs each tool.
SERVICES = {
    "convert-from-pdf": "pdf-to-word pdf-to-docx pdf-to-excel pdf-to-xlsx pdf-to-powerpoint pdf-to-ppt pdf-to-pptx pdf-to-image pdf-to-img pdf-to-html pdf-to-text pdf-to-txt pdf-to-pdfa pdf-to-odt pdf-to-ods pdf-to-odp".split(),
    "convert-to-pdf": "word-to-pdf excel-to-pdf powerpoint-to-pdf ppt-to-pdf html-to-pdf image-to-pdf img-to-pdf odt-to-pdf ods-to-pdf odp-to-pdf word-to-odt excel-to-ods powerpoint-to-odp".split(),
    "organize-pdf": "merge-pdf split-pdf rotate-pdf remove-pages extract-pages organize-pdf scan-to-pdf watermark-pdf protect-pdf unlock-pdf sign-pdf edit-pdf add-page-numbers".split(),
    "optimize-pdf": "compress-pdf repair-pdf ocr-pdf".split(),
}

# Extensions of what tools make; other tools make .pdf.
OUTPUTS = {
    ".docx": ["pdf-to-word"],
    ".xlsx": ["pdf-to-excel"],
    ".pptx": ["pdf-to-powerpoint"],
    ".zip": ["pdf-to-image", "split-pdf", "pdf-to-html"],
    ".txt": ["pdf-to-text"],
    ".odt": ["pdf-to-odt", "word-to-odt"],
    ".ods": ["pdf-to-ods", "excel-to-ods"],
    ".odp": ["pdf-to-odp", "powerpoint-to-odp"],
}

# The media type of what is made, by its extension.
MEDIA_TYPES = {
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".zip": "application/zip",
    ".txt": "text/plain; charset=utf-8",
    ".odt": "application/vnd.oasis.opendocument.text",
    ".ods": "application/vnd.oasis.opendocument.spreadsheet",
    ".odp": "application/vnd.oasis.opendocument.presentation",
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
}

# Tools that take PDF files.
PDF_TOOLS = """pdf-to-word pdf-to-excel pdf-to-powerpoint pdf-to-image pdf-to-html pdf-to-text pdf-to-pdfa pdf-to-odt pdf-to-ods pdf-to-odp
    merge-pdf split-pdf compress-pdf rotate-pdf remove-pages extract-pages organize-pdf watermark-pdf protect-pdf unlock-pdf sign-pdf edit-pdf
    add-page-numbers repair-pdf ocr-pdf ocr""".split()

# The category of what each tool takes, and its extensions; other tools take any and have no category.
TAKES = [
    ("pdf", PDF_TOOLS, [".pdf"]),
    ("image", ["image-to-pdf"], [".png", ".jpg", ".jpeg", ".webp"]),
    ("image", ["scan-to-pdf"], [".png", ".jpg", ".jpeg", ".webp", ".pdf"]),
    ("word", ["word-to-pdf", "word-to-odt"], [".doc", ".docx"]),
    ("excel", ["excel-to-pdf", "excel-to-ods"], [".xls", ".xlsx"]),
    ("ppt", ["powerpoint-to-pdf", "powerpoint-to-odp"], [".ppt", ".pptx"]),
    ("odt", ["odt-to-pdf"], [".odt"]),
    ("ods", ["ods-to-pdf"], [".ods"]),
    ("odp", ["odp-to-pdf"], [".odp"]),
]

# Media types that a file's first bytes may show, by category.
SHOWS = {
    "pdf": ["application/pdf"],
    "image": ["image/png", "image/jpeg", "image/webp"],
    **{office: ["application/zip"] for office in ("word", "excel", "ppt", "odt", "ods", "odp")},
}

# How files of these types begin, in hexadecimal (a dot is any figure).
BEGINS = {"application/pdf": "255044462D", "application/zip": "504B0304", "image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF", "image/webp": "52494646........574542505650"}

# OCR languages by two-letter code.
OCR = {"en": "eng", "es": "spa", "fr": "fra", "de": "deu", "it": "ita", "pt": "por", "zh": "chi_sim", "ja": "jpn", "ko": "kor", "ar": "ara"}


def picked(key: Column, values: dict[str, str], other: Column) -> Column:
    out = other
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def normalize_tool(tool: Column) -> Column:
    """Trimmed, aliases resolved; null for an empty name."""
    t = F.trim(tool)
    return F.when(t != "", picked(t, ALIASES, t))


def tool_service(tool: Column) -> Column:
    out = F.lit(None).cast("string")
    for service, tools in SERVICES.items():
        out = F.when(tool.isin(*tools), service).otherwise(out)
    return out


def base_name(path: Column) -> Column:
    """The last part of a path, without slashes at its end."""
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def extension(path: Column) -> Column:
    """With its dot, from the last dot of the last part; '' if there is none."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def file_ext(path: Column) -> Column:
    return F.lower(F.ltrim(extension(path), F.lit(".")))


def document_name(path: Column, tool: Column) -> Column:
    base = base_name(F.trim(path))
    return F.when((base != "") & (base != "."), base).when(tool != "", F.concat(tool, F.lit(" output"))).otherwise("Processed document")


def output_extension(tool: Column, metadata: Column) -> Column:
    """Of what the tool makes; of images, what the metadata tells."""
    ext = F.lit(".pdf")
    for e, tools in OUTPUTS.items():
        ext = F.when(tool.isin(*tools), e).otherwise(ext)
    told = F.get_json_object(metadata, "$.outputExt")
    return F.when((tool == "pdf-to-image") & told.isin(".png", ".jpg", ".jpeg"), told).otherwise(ext)


def output_name(tool: Column, name: Column, metadata: Column) -> Column:
    """The input's name with the extension of what the tool makes; images by what the metadata tells."""
    return F.concat(F.regexp_replace(name, r"\.[^./]*$", ""), output_extension(tool, metadata))


def output_type(tool: Column, metadata: Column) -> Column:
    """The media type of what the tool makes."""
    return picked(output_extension(tool, metadata), MEDIA_TYPES, F.lit(None).cast("string"))


def input_category(tool: Column) -> Column:
    """What kind of files a tool takes; '' for tools that take any."""
    out = F.lit("")
    for category, tools, _ in TAKES:
        out = F.when(tool.isin(*tools), category).otherwise(out)
    return out


def valid_file(tool: Column, name: Column) -> Column:
    ext = F.lower(extension(name))
    out = F.lit(True)
    for _, tools, extensions in TAKES:
        out = F.when(tool.isin(*tools), ext.isin(*extensions)).otherwise(out)
    return out


def shown_type(head: Column) -> Column:
    """The media type that a file's first bytes show, of those that some tool takes; else null."""
    begin = F.hex(F.substring(head, 1, 16))
    out = F.lit(None).cast("string")
    for kind, start in BEGINS.items():
        out = F.when(begin.rlike(f"^{start}"), kind).otherwise(out)
    return out


def valid_head(tool: Column, head: Column) -> Column:
    """Whether a file's first bytes are of a type that the tool takes; tools without a category take any."""
    category, shown = input_category(tool), shown_type(head)
    out = F.lit(True)
    for name, kinds in SHOWS.items():
        out = F.when(category == name, F.coalesce(shown.isin(*kinds), F.lit(False))).otherwise(out)
    return out


def slugify(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(F.when(s == "", "org").otherwise(s), 1, 40)


def ocr_language(asked: Column) -> Column:
    a = F.trim(asked)
    return F.when(a.isin(*OCR.values()), a).otherwise(picked(a, OCR, F.lit("eng")))


def classify_error(message: Column) -> Column:
    return F.when(message.rlike("(?i)timeout|deadline"), "TIMEOUT").otherwise("CONVERSION_FAILED")


def last_of_each(entries: Column, key: str = "key") -> Column:
    """Structs of an array without those whose key comes again later; a map of them can't meet a key twice. One sort, however many entries there are."""
    placed = lambda e: F.array_sort(F.transform(e, lambda x, i: F.struct(x[key].alias("k"), i.alias("i"))))
    last = lambda p: F.filter(p, lambda x, j: ~F.coalesce(F.get(p, j + 1)["k"].eqNullSafe(x["k"]) & (j + 1 < F.size(p)), F.lit(False)))
    return let(entries, lambda e: F.transform(F.array_sort(F.transform(let(placed(e), last), lambda x: x["i"])), lambda i: F.get(e, i)))


def plan_prices(text: Column) -> Column:
    """"free=0,pro=12" as a map of doubles; parts that aren't a name and a number are left out, of a repeated name the last counts."""
    number = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

    def entry(part: Column) -> Column:
        name, value = F.trim(F.substring_index(part, "=", 1)), F.trim(F.regexp_extract(part, r"^[^=]*=(.*)$", 1))
        return F.struct(F.when(F.contains(part, F.lit("=")), name).otherwise("").alias("key"), F.when(value.rlike(number), value.try_cast("double")).alias("value"))

    good = F.filter(F.transform(F.split(text, ","), entry), lambda e: (e["key"] != "") & e["value"].isNotNull())
    return F.map_from_entries(last_of_each(good))


def format_duration(seconds: Column) -> Column:
    d, h, m = F.floor(seconds / 86400), F.floor(seconds % 86400 / 3600), F.floor(seconds % 3600 / 60)
    return F.when(d > 0, F.format_string("%dd %dh %dm", d, h, m)).when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm", m))


def compression_ratio(original: Column, compressed: Column) -> Column:
    # a tie goes to the even digit
    return F.format_string("%.2f%%", F.bround(F.when(original > 0, (original - compressed) * 100.0 / original).otherwise(F.lit(0.0)), 2))


def safe_dpi(width: Column, height: Column, asked: Column, longest: Column) -> Column:
    """The dots per inch at which the longer side (in points) has no more than `longest` pixels; from 1 to what was asked."""
    side = F.greatest(width, height)
    return F.when(side <= 0, asked).otherwise(F.greatest(F.lit(1), F.least(asked, F.floor(longest * 72.0 / side).cast("int"))))


def cache_key(tool: Column, options: Column, etags: Column) -> Column:
    """SHA-256 of the tool, its options (as canonical JSON) and the inputs' tags in order, each ended by a zero byte."""
    zero = F.decode(F.unhex(F.lit("00")), "UTF-8")
    tags = F.transform(F.array_sort(etags), lambda e: F.concat(e, zero))
    return F.sha2(F.concat(tool, zero, options, zero, F.array_join(tags, "")), 256)


def numbers_of(part: Column, most: Column) -> Column:
    """"3" or "2-5" as page numbers within 1..most; anything else as none."""
    p = F.trim(part)
    first = F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
    last = F.coalesce(F.regexp_extract(p, r"^\d+\s*-\s*(\d+)$", 1).try_cast("int"), first)
    a, b = F.greatest(first, F.lit(1)), F.least(last, most)
    return F.when(p.rlike(r"^\d+(\s*-\s*\d+)?$") & (a <= b), F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def parse_page_range(text: Column, most: Column) -> Column:
    """"1-3,5" as distinct page numbers in order; '' and 'all' are all pages."""
    whole = F.lower(F.trim(text)).isin("", "all")
    every = F.when(most >= 1, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    some = F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(text, ","), lambda p: numbers_of(p, most)))))
    return F.when(whole, every).otherwise(some)


def page_range_groups(text: Column, most: Column) -> Column:
    """One list of pages for each part, in the parts' order; parts without pages are left out."""
    return F.filter(F.transform(F.split(text, ","), lambda p: numbers_of(p, most)), lambda g: F.size(g) > 0)


def split_equal(pages: Column, n: Column) -> Column:
    """Pages 1..pages in n groups, the first ones longer by one where it doesn't come out even; no empty groups."""
    n = F.greatest(F.lit(1), F.least(n, pages))
    size, extra = F.floor(pages / n).cast("int"), (pages % n).cast("int")
    start = lambda i: i * size + F.least(i, extra) + 1
    return F.when(pages >= 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sequence(start(i), start(i + 1) - 1))).otherwise(F.array().cast("array<array<int>>"))


def split_span(pages: Column, span: Column) -> Column:
    """Pages in groups of `span`."""
    starts = F.sequence(F.lit(1), pages, span)
    return F.when((pages >= 1) & (span >= 1), F.transform(starts, lambda a: F.sequence(a, F.least(a + span - 1, pages)))).otherwise(F.array().cast("array<array<int>>"))


def part_numbers(text: Column, total: Column) -> Column:
    """Upload parts; null if any isn't a number from 1 to total."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("int"))
    return F.when(F.forall(parts, lambda p: F.coalesce((p >= 1) & (p <= total), F.lit(False))), parts)


def quad_area(x: list[Column], y: list[Column]) -> Column:
    """Shoelace area of a quadrilateral from its corners in order."""
    terms = [x[i] * y[(i + 1) % 4] - x[(i + 1) % 4] * y[i] for i in range(4)]
    return F.abs(reduce(lambda a, b: a + b, terms)) / 2


def quad_convex(x: list[Column], y: list[Column]) -> Column:
    """Whether all turns from side to side have one direction; corners in one line are degenerate."""
    turns = []
    for i in range(4):
        j, k = (i + 1) % 4, (i + 2) % 4
        turns.append((x[j] - x[i]) * (y[k] - y[j]) - (y[j] - y[i]) * (x[k] - x[j]))
    return (F.least(*turns) >= 1e-12) | (F.greatest(*turns) <= -1e-12)


def quad_angles(x: list[Column], y: list[Column]) -> list[Column]:
    """The inner angle at each corner in degrees; 0 where two corners are the same."""
    out = []
    for i in range(4):
        to = [(x[k] - x[i], y[k] - y[i]) for k in ((i + 3) % 4, (i + 1) % 4)]
        size = F.hypot(*to[0]) * F.hypot(*to[1])
        cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (to[0][0] * to[1][0] + to[0][1] * to[1][1]) / F.nullif(size, F.lit(0.0))))
        out.append(F.coalesce(F.degrees(F.acos(cosine)), F.lit(0.0)))
    return out


def quad_usable(x: list[Column], y: list[Column]) -> Column:
    """Corners in or near the unit square, convex, an area of 0.05 or more, angles from 30 to 150 degrees."""
    near = F.forall(F.array(*x, *y), lambda v: v.between(-0.05, 1.05))
    sharp = F.forall(F.array(*quad_angles(x, y)), lambda a: a.between(30, 150))
    return near & quad_convex(x, y) & (quad_area(x, y) >= 0.05) & sharp


def ordered_corners(points: Column) -> Column:
    """Of four points (structs of x and y) the top left, top right, bottom right and bottom left ones; of equal ones the first."""

    def first(by: Column, largest: bool) -> Column:
        values = F.transform(points, (lambda p: p["x"] + p["y"]) if by == "sum" else (lambda p: p["x"] - p["y"]))
        return F.element_at(points, F.array_position(values, F.array_max(values) if largest else F.array_min(values)).cast("int"))

    return F.struct(first("sum", False).alias("tl"), first("difference", True).alias("tr"), first("sum", True).alias("br"), first("difference", False).alias("bl"))
