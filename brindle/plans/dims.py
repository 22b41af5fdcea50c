"""Fixed dimension tables: identifiers of payload flavors, their ranks, and what is published for each kind of item.

Fixed values throughout: names, numbers and orders that readers and writers of these formats share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WINDOWS, MACOS, UNIX = "Windows", "MacOs", "Unix"
PLATFORMS = (WINDOWS, MACOS, UNIX)

#: flavor: (read rank, is content, Windows format, uniform type identifier, MIME type)
FLAVORS: dict[str, tuple[int, bool, str | None, str | None, str | None]] = {
    "ShellLink": (0, True, None, None, None),
    "ShellIdList": (1, True, "Shell IDList Array", None, None),
    "FileList": (2, True, "CF_HDROP", "public.file-url", "text/uri-list"),
    "FileDescriptor": (3, True, "FileGroupDescriptorW", None, None),
    "WebArchive": (3, True, None, "com.apple.webarchive", None),
    "Rtf": (4, True, "Rich Text Format", "public.rtf", "text/rtf"),
    "Html": (5, True, "HTML Format", "public.html", "text/html"),
    "Png": (6, True, "PNG", "public.png", "image/png"),
    "Tiff": (7, True, "CF_TIFF", "public.tiff", "image/tiff"),
    "DibV5": (8, True, "CF_DIBV5", None, "image/bmp"),
    "Dib": (9, True, "CF_DIB", None, "image/bmp"),
    "Jpeg": (10, True, "JFIF", "public.jpeg", "image/jpeg"),
    "Gif": (11, True, "GIF", "com.compuserve.gif", "image/gif"),
    "Url": (12, True, "UniformResourceLocatorW", "public.url", "text/uri-list"),
    "PlainText": (13, True, "CF_UNICODETEXT", "public.utf8-plain-text", "text/plain;charset=utf-8"),
    "PlainTextUtf16": (14, True, None, "public.utf16-external-plain-text", None),
    "UrlName": (15, False, None, "public.url-name", None),
    "FileContents": (15, True, "FileContents", None, None),
    "DropEffect": (15, False, "Preferred DropEffect", None, None),
    "Other": (255, True, None, None, None),
}

#: (platform, identifier): flavor
NATIVE: dict[tuple[str, str], str] = {
    (WINDOWS, "CF_UNICODETEXT"): "PlainText",
    (WINDOWS, "CF_TEXT"): "PlainText",
    (WINDOWS, "CF_OEMTEXT"): "PlainText",
    (WINDOWS, "CF_TIFF"): "Tiff",
    (WINDOWS, "CF_DIB"): "Dib",
    (WINDOWS, "CF_DIBV5"): "DibV5",
    (WINDOWS, "CF_HDROP"): "FileList",
    (WINDOWS, "HTML Format"): "Html",
    (WINDOWS, "Rich Text Format"): "Rtf",
    (WINDOWS, "Rich Text Format Without Objects"): "Rtf",
    (WINDOWS, "PNG"): "Png",
    (WINDOWS, "JFIF"): "Jpeg",
    (WINDOWS, "GIF"): "Gif",
    (WINDOWS, "Shell IDList Array"): "ShellIdList",
    (WINDOWS, "FileGroupDescriptorW"): "FileDescriptor",
    (WINDOWS, "FileGroupDescriptor"): "FileDescriptor",
    (WINDOWS, "FileContents"): "FileContents",
    (WINDOWS, "UniformResourceLocatorW"): "Url",
    (WINDOWS, "UniformResourceLocator"): "Url",
    (WINDOWS, "Preferred DropEffect"): "DropEffect",
    (MACOS, "public.utf8-plain-text"): "PlainText",
    (MACOS, "public.plain-text"): "PlainText",
    (MACOS, "NSStringPboardType"): "PlainText",
    (MACOS, "public.utf16-external-plain-text"): "PlainTextUtf16",
    (MACOS, "NSUnicodePboardType"): "PlainTextUtf16",
    (MACOS, "com.apple.webarchive"): "WebArchive",
    (MACOS, "Apple Web Archive pasteboard type"): "WebArchive",
    (MACOS, "public.html"): "Html",
    (MACOS, "Apple HTML pasteboard type"): "Html",
    (MACOS, "public.rtf"): "Rtf",
    (MACOS, "NeXT Rich Text Format v1.0 pasteboard type"): "Rtf",
    (MACOS, "public.png"): "Png",
    (MACOS, "Apple PNG pasteboard type"): "Png",
    (MACOS, "public.jpeg"): "Jpeg",
    (MACOS, "com.compuserve.gif"): "Gif",
    (MACOS, "public.tiff"): "Tiff",
    (MACOS, "NeXT TIFF v4.0 pasteboard type"): "Tiff",
    (MACOS, "public.file-url"): "FileList",
    (MACOS, "NSFilenamesPboardType"): "FileList",
    (MACOS, "public.url"): "Url",
    (MACOS, "Apple URL pasteboard type"): "Url",
    (MACOS, "public.url-name"): "UrlName",
    (UNIX, "text/plain"): "PlainText",
    (UNIX, "UTF8_STRING"): "PlainText",
    (UNIX, "STRING"): "PlainText",
    (UNIX, "TEXT"): "PlainText",
    (UNIX, "text/html"): "Html",
    (UNIX, "text/rtf"): "Rtf",
    (UNIX, "application/rtf"): "Rtf",
    (UNIX, "text/richtext"): "Rtf",
    (UNIX, "image/png"): "Png",
    (UNIX, "image/jpeg"): "Jpeg",
    (UNIX, "image/gif"): "Gif",
    (UNIX, "image/tiff"): "Tiff",
    (UNIX, "image/bmp"): "Dib",
    (UNIX, "image/x-bmp"): "Dib",
    (UNIX, "image/x-MS-bmp"): "Dib",
    (UNIX, "text/uri-list"): "FileList",
}

#: Four-character type codes behind "CorePasteboardFlavorType 0x" and eight hex digits.
OSTYPES = {
    "TEXT": "PlainText",
    "utf8": "PlainText",
    "ut16": "PlainTextUtf16",
    "utxt": "PlainTextUtf16",
    "RTF ": "Rtf",
    "rtf ": "Rtf",
    "HTML": "Html",
    "PNGf": "Png",
    "TIFF": "Tiff",
    "JPEG": "Jpeg",
    "GIFf": "Gif",
    "furl": "FileList",
    "url ": "Url",
    "urln": "UrlName",
}

#: Numeric clipboard formats: number: (canonical name, flavor)
WINDOWS_NUMBERS: dict[int, tuple[str | None, str]] = {
    1: ("CF_TEXT", "PlainText"),
    2: ("CF_BITMAP", "Other"),
    6: ("CF_TIFF", "Tiff"),
    7: ("CF_OEMTEXT", "PlainText"),
    8: ("CF_DIB", "Dib"),
    13: ("CF_UNICODETEXT", "PlainText"),
    15: ("CF_HDROP", "FileList"),
    17: ("CF_DIBV5", "DibV5"),
}

#: kind: platform: (flavor, fidelity) in order of publication; F full, L lossy, S sidecar
_EVERY = {
    "Text": [("PlainText", "F")],
    "Html": [("Html", "F"), ("PlainText", "L")],
}
WRITE_PLAN: dict[tuple[str, str], list[tuple[str, str]]] = {
    **{(k, p): v for k, v in _EVERY.items() for p in PLATFORMS},
    ("RichText", WINDOWS): [("Rtf", "F"), ("Html", "F"), ("PlainText", "L")],
    ("RichText", MACOS): [("Rtf", "F"), ("Html", "F"), ("PlainText", "L")],
    ("RichText", UNIX): [("Html", "F"), ("Rtf", "F"), ("PlainText", "L")],
    ("Image", WINDOWS): [("DibV5", "F"), ("Png", "F"), ("Dib", "L")],
    ("Image", MACOS): [("Png", "F"), ("Tiff", "F")],
    ("Image", UNIX): [("Png", "F")],
    ("Files", WINDOWS): [("FileList", "F"), ("DropEffect", "S")],
    ("Files", MACOS): [("FileList", "F")],
    ("Files", UNIX): [("FileList", "F"), ("x-special/gnome-copied-files", "F"), ("x-special/mate-copied-files", "F"), ("application/x-kde-cutselection", "S")],
    ("PromisedFiles", WINDOWS): [("FileDescriptor", "F")],
    ("Link", WINDOWS): [("Url", "F"), ("PlainText", "L")],
    ("Link", MACOS): [("Url", "F"), ("UrlName", "S"), ("PlainText", "L")],
    ("Link", UNIX): [("Url", "F"), ("PlainText", "L")],
}
FIDELITY = {"F": "Full", "L": "Lossy", "S": "Sidecar"}
KINDS = ("Text", "RichText", "Html", "Image", "Files", "PromisedFiles", "Link", "Shortcut", "ShellItems", "Unknown")

#: Windows code page number: (label, Python codec); 819 is another number of 28591
CODE_PAGES: dict[int, tuple[str, str]] = {
    1250: ("windows-1250", "cp1250"),
    1251: ("windows-1251", "cp1251"),
    1252: ("windows-1252", "cp1252"),
    1253: ("windows-1253", "cp1253"),
    1254: ("windows-1254", "cp1254"),
    1255: ("windows-1255", "cp1255"),
    1256: ("windows-1256", "cp1256"),
    1257: ("windows-1257", "cp1257"),
    1258: ("windows-1258", "cp1258"),
    437: ("IBM437", "cp437"),
    850: ("IBM850", "cp850"),
    10000: ("macintosh", "mac_roman"),
    28591: ("ISO-8859-1", "latin-1"),
}

#: Errors that decoders report as data.
ERROR_KINDS = ("UnexpectedEof", "BadMagic", "BadLength", "BadOffset", "Unsupported", "InvalidUtf8", "InvalidUtf16", "DepthLimit", "TooLarge", "Malformed")

#: Their spelling in prose.
ERROR_PROSE = {
    "unexpected end of input": "UnexpectedEof",
    "bad magic": "BadMagic",
    "bad length field": "BadLength",
    "bad offset field": "BadOffset",
    "unsupported construct": "Unsupported",
    "invalid UTF-8": "InvalidUtf8",
    "invalid UTF-16": "InvalidUtf16",
    "nesting depth limit exceeded": "DepthLimit",
    "declared size too large": "TooLarge",
    "malformed": "Malformed",
}

#: X11 targets that must not be asked for.
DENIED_TARGETS = ("TARGETS", "MULTIPLE", "SAVE_TARGETS", "DELETE", "INSERT_SELECTION", "INSERT_PROPERTY")


def flavors(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in FLAVORS.items()]
    return spark.createDataFrame(rows, "flavor string, read_rank int, is_content boolean, windows_name string, uti string, mime string")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, n, f) for (p, n), f in NATIVE.items()], "platform string, native string, flavor string")


def ostypes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(OSTYPES.items()), "ostype string, flavor string")


def windows_numbers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in WINDOWS_NUMBERS.items()], "code int, name string, flavor string")


def write_plan(spark: SparkSession) -> DataFrame:
    rows = [(k, p, i, f, FIDELITY[x]) for (k, p), plan in WRITE_PLAN.items() for i, (f, x) in enumerate(plan)]
    return spark.createDataFrame(rows, "kind string, platform string, position int, flavor string, fidelity string")


def code_pages(spark: SparkSession) -> DataFrame:
    rows = [(n, n, *x) for n, x in CODE_PAGES.items()] + [(819, 28591, *CODE_PAGES[28591])]
    return spark.createDataFrame(rows, "number int, canonical int, label string, codec string")


def values_sql(rows: list[tuple], names: str) -> str:
    """A VALUES list for SQL engines, as a derived table."""

    def lit(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({names}))"
