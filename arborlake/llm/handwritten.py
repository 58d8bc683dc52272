"""Generated, minified, vendored and data-bearing source files.

A source file is set apart by its path (folders of third-party code and of
generators), by its name (suffixes that tools write), by a notice that is a
comment line of its own, or by its layout: line lengths, shares of white space
and letters, density of numeric literals and long encoded runs, held against
thresholds of its language.  All of it is built-in expressions over the whole
text, so the scan is one narrow stage without a shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.operators.rulejoin import let
from arborlake.plans.rules import EXT_TO_LANGUAGE

#: Extensions of source files and their languages.
LANGUAGE_OF_EXTENSION = dict(EXT_TO_LANGUAGE)

#: Folders that hold third-party copies, at any depth, in lower case.
VENDOR_FOLDERS = (
    "vendor", "_vendor", "vendored", "node_modules", "bower_components", "jspm_packages", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party",
    "3rd-party", "pods", "carthage", "deps", "external", "externals", "site-packages", "dist-packages", "godeps",
)
#: Folders that generators write to.
GENERATED_FOLDERS = ("generated", "__generated__", "_generated", "gen-src", "autogen", "autogenerated", "auto-generated", "generated-sources", "generated-src", "generated_src", "src-gen", "codegen-out")

_VENDOR_NAME = r"(?i)[-_.]v?\d+\.\d+(?:\.\d+)+(?:[-.](?:min|slim|prod|pack))?\.[a-z]+$|^(?:jquery|bootstrap|lodash|modernizr|angular|react|vue|d3|moment)(?:[-.](?:min|slim|ui|core))*\.(?:js|mjs|cjs)$"
_GENERATED_NAME = (
    r"(?i)\.pb\.[a-z]+$|\.pb\.gw\.go$|_pb2(?:_grpc)?\.pyi?$|_pb\.(?:js|ts|rb|d\.ts)$|_grpc\.pb\.[a-z]+$|\.g\.(?:cs|dart|i\.cs)$|\.(?:generated|gen|autogen|freezed|gr|config\.gen|mocks)\.[a-z]+$"
    r"|[._-](?:generated|autogen)\.[a-z]+$|_gen\.(?:go|rs|py|ts|js|java|cs|kt)$|\.designer\.(?:cs|vb)$|^(?:moc|qrc|ui)_\w+\.(?:cpp|cc|cxx|h|hpp|py)$|^zz_generated[._].*|^bindata\.go$|_string\.go$|\.tab\.[ch](?:pp)?$|^lex\.yy\.c$"
)
_MINIFIED_NAME = r"(?i)[.\-_]min\.[a-z]+$|[.-](?:bundle|chunk|packed|prod)\.(?:js|mjs|cjs)$|^(?:bundle|chunk)[.-][0-9a-f]{6,}\.|^[\w-]+[.-](?=[0-9a-f]*\d)[0-9a-f]{8,20}\.(?:chunk\.)?(?:js|mjs|cjs)$"

# What may stand before a notice on its line: comment signs and blanks alone, so that a string that holds such words is no notice.
_LEAD = r"(?im)^[ \t]*+(?:[/*#;%<!'{\-]++|REM\b)[ \t]*+"
_GENERATED_NOTICE = _LEAD + (
    r"(?:"
    r"@generated\b"
    r"|</?auto-?generated\b"
    r"|(?:this|the) (?:file|code|class|source|module)(?: here)? (?:is|was|has been) (?:an? |the )?(?:auto[- ]?)?(?:automatically |machine )?(?:generated|produced|created|written) (?:file|by|from|automatically)"
    r"|this (?:file|code) (?:is|was) auto"
    r"|this is an? (?:auto[- ]?)?(?:automatically )?generated file"
    r"|(?:code |file |automatically |auto[- ]?|machine[- ]){1,4}generated\b(?! (?:client|code|file|parser|bundle)s? (?:lives?|is|are|elsewhere))(?=[^\n]*(?:\bby\b|\bfrom\b|\bfile\b|\bon\b|edit|modify|;|\.|$))"
    r"|generated (?:\w+ )?(?:from|by|with|using|automatically|on)\b"
    r"|machine[- ](?:written|made) by\b"
    r"|do not (?:edit|modify|change)(?: (?:this|the) file| by hand| manually)?[ \t]*(?:[.!;:,*-]|$)"
    r"|(?:@@|==|--|##)?[ \t]*[\w.-]+ output, (?:checksum|hash|digest)\b"
    r"|diese datei w(?:ird|urde) (?:automatisch|maschinell)"
    r"|(?:ce )?fichier (?:est )?(?:produit|g[ée]n[ée]r[ée]|cr[ée]{2}) automatiquement"
    r"|(?:este )?(?:archivo|ficheiro|arquivo) (?:fue |es |foi |[ée] )?(?:generado|gerado|criado|creado) autom"
    r"|[^\n]{0,80}(?:nicht (?:von hand |manuell )?(?:bearbeiten|[äa]ndern)|ne pas (?:modifier|[ée]diter)|no (?:editar|modificar)|n[ãa]o (?:editar|modificar|edite))"
    r"|[^\n]{0,80}\bdo not (?:edit|modify)[ \t]*[.!*-]*[ \t]*$"
    r"|[^\n]{0,80}(?:manual changes will be lost|edits here are overwritten|changes (?:to this file )?will be (?:lost|overwritten))"
    r")"
)
_VENDOR_NOTICE = _LEAD + (
    r"(?:"
    r"[^\n]{0,120}\bunmodified (?:upstream )?copy\b"
    r"|copied (?:verbatim |unchanged )?from (?:the )?upstream\b"
    r"|(?:vendored|imported) from (?:the )?(?:upstream|https?:)"
    r"|this file is part of (?:the )?[\w.-]+,? (?:release|version|v?\d)"
    r"|[\w.@/-]+ v?\d+\.\d+(?:\.\d+)* (?:-|\||—) (?:\(c\)|copyright|©|(?:the )?(?:mit|bsd|apache|isc|mpl))"
    r")"
)
_MINIFIED_NOTICE = r"(?m)^[ \t]*//[#@] sourceMappingURL="

# Java's matcher recurses into repeated groups: what may be long is matched by possessive classes or possessive groups only. No literal opens
# at an escaped quote, so an unclosed one is tried once a line and not at each quote in it. Triple quotes are signs of their own here: what
# they enclose counts line by line, as notes on code often stand in them.
# Alternatives begin with a look at the next sign, so that most positions cost one comparison.
_STRINGS = r"""(?=["'])(?<!\\)(?:"{3}|'{3}|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+')|`[^`]*+`"""
_LONG_STRINGS = r"""(?=["'])(?<!\\)(?:"{3}(?:[^"\\]++|\\[\s\S]|"(?!""))*+"{3}|'{3}(?:[^'\\]++|\\[\s\S]|'(?!''))*+'{3})"""
_NUMBERS = r"(?=[-0-9])(?<![\w.])-?(?:0[xX][0-9A-Fa-f]+|\d+(?:\.\d+)?)(?![\w])"
_ENCODED = r"[A-Za-z0-9+/=_\-]{40,}+|[\\x0-9A-Fa-f]{40,}+"
# Encoded runs that can't be rulers, paths or long names: with some digits, or long and of letters and digits alone.
_BLOBS = r"(?<![A-Za-z0-9+/=_\-])(?=(?:[A-Za-z+/=_\-]*+\d){3})[A-Za-z0-9+/=_\-]{40,}+|[A-Za-z0-9+]{60,}+|(?:\\x[0-9A-Fa-f]{2}){10,}+"
# A text without this holds no encoded run of either kind.
_ANY_RUN = r"(?<![A-Za-z0-9+/=_\\\-])[A-Za-z0-9+/=_\\\-]{40}"

#: Layout thresholds: (line length, mean line length, white space at most) that make a text minified; (numeric literals per 100 characters,
#: share of letters outside literals at most, share of encoded runs, alphanumeric share) that make it data.
DEFAULT_LIMITS = (500, 160.0, 0.15, 5.0, 0.10, 0.25, 0.85)
LIMITS = {
    # scripts for browsers are what minifiers write, often wrapped at some hundred columns
    "JavaScript": (300, 110.0, 0.15, 5.0, 0.10, 0.25, 0.85),
    "TypeScript": (400, 130.0, 0.15, 5.0, 0.10, 0.25, 0.85),
    # white space is syntax here, so single-line code keeps more of it
    "Python": (500, 160.0, 0.20, 5.0, 0.10, 0.25, 0.85),
    # quoting words is common in shell and R scripts
    "Shell": (500, 200.0, 0.15, 6.0, 0.06, 0.30, 0.88),
    "R": (500, 200.0, 0.15, 6.0, 0.08, 0.30, 0.88),
}
#: Shares are held against the thresholds as if so many characters of ordinary code stood beside the text, so a text of a few characters
#: says little and a longer one is judged by itself; there is no length at which the rules set in.
ORDINARY_CHARS, ORDINARY_LETTERS = 40, 0.6
#: Steps of a running count of numbers, and share of lines of the same shape as the one a period (of 2 to 8 lines) before, that only tools write.
LEAST_COUNT, LEAST_REPEATS = 6, 0.8


def extension_of(ext: Column, name: Column) -> Column:
    """The extension in lower case, from the name where it is null; '' for names without one."""
    own = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    return F.lower(F.coalesce(ext, own))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _settled(share: Column, whole: Column, usual: float = 0.0) -> Column:
    """A share of ``whole`` characters as it is once the characters of ordinary code stand beside them."""
    return (share * whole + ORDINARY_CHARS * usual) / (whole + ORDINARY_CHARS)


def _count_run(text: Column) -> Column:
    """The longest run of whole numbers each of which is the one before or one more, in steps up."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(?=\d)(?<![\w.])(\d{1,9})(?![\w.])"), F.lit(1)), lambda n: n.cast("int"))
    start = F.struct(F.lit(-9).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def step(so_far: Column, n: Column) -> Column:
        run = F.when(n == so_far["last"] + 1, so_far["run"] + 1).when(n == so_far["last"], so_far["run"]).otherwise(0)
        return F.struct(n.alias("last"), run.alias("run"), F.greatest(so_far["top"], run).alias("top"))

    return F.aggregate(numbers, start, step, lambda x: x["top"])


def _repeat_share(text: Column) -> Column:
    """The largest share, over periods of 2 to 8 lines, of lines that have the shape of the line a period before and not that of the line before."""
    shape = lambda line: F.regexp_replace(F.regexp_replace(line, r"[A-Za-z_]\w*+|\d++", "w"), r"\s++", "")
    shapes = F.transform(F.filter(F.split(text, r"\r?\n"), lambda line: F.btrim(line) != ""), shape)

    def share(lines: Column, period: int) -> Column:
        before = F.slice(lines, period, F.size(lines))
        here = F.zip_with(F.slice(lines, 1 + period, F.size(lines)), before, lambda x, y: F.when(x != y, x))
        pairs = F.zip_with(here, lines, lambda x, y: F.coalesce(x == y, F.lit(False)))
        return F.when(F.size(lines) > 3 * period, F.size(F.filter(pairs, lambda same: same)) / (F.size(lines) - period)).otherwise(0.0)

    return let(shapes, lambda lines: F.greatest(*(share(lines, k) for k in range(2, 9))))


def _statistics(content: Column, all_of_them: bool = True) -> Column:
    """The layout statistics of a text as one struct, in which each part of the work is done once.

    Without ``all_of_them`` the density of numbers and the alphanumeric share, which only matter where letters are few, are 0 elsewhere.
    """
    most_letters = 2 * max(v[4] for v in (DEFAULT_LIMITS, *LIMITS.values()))

    def made(text: Column, base: Column, run: Column, closed: Column, opened: Column) -> Column:
        chars, dense, runs = base["chars"], base["dense"], base["runs"]
        few = _settled(_share(F.least(closed, opened), dense), dense, ORDINARY_LETTERS) <= most_letters
        if_few = lambda value: value if all_of_them else F.when(few, value).otherwise(0.0)
        run_chars = lambda pattern: F.when(runs, chars - F.length(F.regexp_replace(text, pattern, ""))).otherwise(0)
        return F.struct(
            chars.alias("chars"),
            F.array_max(base["lengths"]).alias("max_line"),
            _share(dense.cast("double"), F.size(F.filter(base["lengths"], lambda n: n > 0))).alias("mean_line"),
            _share(chars - dense, chars).alias("white_share"),
            if_few(_share(F.length(F.regexp_replace(text, r"[^A-Za-z0-9\u0080-\uffff]+", "")), chars)).alias("alnum_share"),
            if_few(100 * _share(F.regexp_count(text, F.lit(_NUMBERS)), chars)).alias("number_density"),
            _share(run_chars(_ENCODED), chars).alias("encoded_share"),
            _share(run_chars(_BLOBS), chars).alias("blob_share"),
            _share(closed, dense).alias("letter_share"),
            _share(opened, dense).alias("open_share"),
            run.alias("count_run"),
            F.when(run >= LEAST_COUNT, _repeat_share(text)).otherwise(0.0).alias("repeat_share"),
        )

    def letters(text: Column, base: Column, *literals: str) -> Column:
        left = lambda *patterns: F.length(F.regexp_replace(F.regexp_replace(text, "|".join(patterns), ""), r"[^A-Za-z\u0080-\uffff]+", ""))
        return F.when(base["runs"], left(*literals, _BLOBS, _NUMBERS)).otherwise(left(*literals, _NUMBERS))

    def opened(text: Column, base: Column, closed: Column) -> Column:
        # without triple quotes there is nothing more to leave out
        return F.when(F.contains(text, F.lit('"""')) | F.contains(text, F.lit("'''")), letters(text, base, _LONG_STRINGS, _STRINGS)).otherwise(closed)

    def based(text: Column) -> Column:
        lengths = F.transform(F.split(text, r"\r?\n"), lambda line: F.length(F.rtrim(line)))
        base = F.struct(F.length(text).alias("chars"), F.length(F.regexp_replace(text, r"\s+", "")).alias("dense"), lengths.alias("lengths"), text.rlike(_ANY_RUN).alias("runs"))
        return let(base, lambda b: let(_count_run(text), lambda run: let(letters(text, b, _STRINGS), lambda c: let(opened(text, b, c), lambda o: made(text, b, run, c, o)))))

    return let(F.coalesce(content, F.lit("")), based)


def layout_statistics(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with layout statistics of the whole text: ``max_line``, ``mean_line``, ``white_share``, ``alnum_share``, ``number_density``, ``encoded_share``,
    ``blob_share``, ``letter_share``, ``open_share``, ``count_run``, ``repeat_share``.

    A null text counts as an empty one, whose statistics are 0.  CRLF ends a
    line like LF.  ``letter_share`` is the share of letters outside string
    literals and encoded runs in all that is not white space; ``open_share``
    leaves out what stands between triple quotes as well.  ``blob_share`` is
    the share of encoded runs other than rulers, paths and long names.
    ``count_run`` is the number of steps of the longest running count of
    numbers; ``repeat_share``, the share of lines shaped like those a period
    before, is measured only where there is such a count, and 0 elsewhere.
    """
    out = df.withColumn("_layout", _statistics(F.col(content)))
    return out.withColumns({n: F.col("_layout")[n] for n in out.schema["_layout"].dataType.names}).drop("_layout")


_LIMIT_NAMES = ("longest", "mean", "white", "numbers", "letters", "encoded", "alnum")


def _limits(language: Column) -> Column:
    """The layout thresholds of a language as one struct."""
    named = lambda values: dict(zip(_LIMIT_NAMES, map(float, values)))
    kind = "struct<" + ",".join(f"{n}:double" for n in _LIMIT_NAMES) + ">"
    own = F.from_json(F.lit(json.dumps({k: named(v) for k, v in LIMITS.items()})), f"map<string,{kind}>")[language]
    return F.coalesce(own, F.from_json(F.lit(json.dumps(named(DEFAULT_LIMITS))), kind))


def _layout_verdict(s: Column, limit: Column) -> Column:
    """'generated', 'minified' or 'data' where the statistics ``s`` say so, else null."""
    chars = s["chars"]
    packed = (s["max_line"] >= limit["longest"]) & (s["mean_line"] >= limit["mean"]) & (s["white_share"] <= limit["white"])
    signs = (
        (_settled(s["number_density"], chars) >= limit["numbers"]) | (_settled(s["encoded_share"], chars) >= limit["encoded"])
        | (_settled(s["alnum_share"], chars, ORDINARY_LETTERS) >= limit["alnum"])
    )
    closed, opened = (_settled(s[c], chars * (1 - s["white_share"]), ORDINARY_LETTERS) for c in ("letter_share", "open_share"))
    few = (closed <= limit["letters"]) | ((F.least(closed, opened) <= 2 * limit["letters"]) & signs)
    # a text that is encoded for the most part is data whatever else it holds; a small blob in code is not
    data = few | (_settled(s["blob_share"], chars) >= 2 * limit["encoded"])
    counted = (s["count_run"] >= LEAST_COUNT) & (s["repeat_share"] >= LEAST_REPEATS)
    return F.when(counted, "generated").when(packed, "minified").when(data, "data")


class _Signs:
    """What path, name and text of a file say, as columns."""

    def __init__(self, path: str, name: str, ext: str, content: str):
        file_name = F.coalesce(F.col(name), F.element_at(F.split(F.col(path), "/"), -1))
        folders = F.lower(F.coalesce(F.col(path), F.lit("")))
        in_folder = lambda names: folders.rlike(r"(?:^|/)(?:" + "|".join(n.replace("-", r"\-") for n in names) + r")/(?=.)")
        named = lambda pattern: F.coalesce(file_name.rlike(pattern), F.lit(False))
        text = F.coalesce(F.col(content), F.lit(""))
        self.language = F.from_json(F.lit(json.dumps(LANGUAGE_OF_EXTENSION)), "map<string,string>")[extension_of(F.col(ext), file_name)]
        self.vendor_path, self.tool_path = in_folder(VENDOR_FOLDERS), in_folder(GENERATED_FOLDERS)
        self.vendor_name, self.tool_name, self.packed_name = named(_VENDOR_NAME), named(_GENERATED_NAME), named(_MINIFIED_NAME)
        self.vendor_notice, self.tool_notice, self.packed_notice = text.rlike(_VENDOR_NOTICE), text.rlike(_GENERATED_NOTICE), text.rlike(_MINIFIED_NOTICE)

    def packed_text(self, s: Column, limit: Column) -> Column:
        return self.packed_notice & (s["max_line"] >= limit["longest"])

    def origin(self, layout: Column) -> Column:
        """Path and name are asked before the text, notices before the layout; what is settled is not asked further."""

        def by_layout(s: Column, limit: Column) -> Column:
            verdict = _layout_verdict(s, limit)
            return let(verdict, lambda v: F.when(v == "generated", v).when(self.packed_name | self.packed_text(s, limit), "minified").otherwise(F.coalesce(v, F.lit("handwritten"))))

        return (
            F.when(self.language.isNull(), F.lit(None).cast("string"))
            .when(self.vendor_path | self.vendor_name, "vendored")
            .when(self.tool_path | self.tool_name, "generated")
            .when(self.vendor_notice, "vendored")
            .when(self.tool_notice, "generated")
            .when(self.packed_name, "minified")
            .otherwise(let(layout, lambda s: let(_limits(self.language), lambda limit: by_layout(s, limit))))
        )

    def evidence(self, layout: Column) -> Column:
        """All kinds of signs that speak against hand-written source; null for files that are no source."""
        notice = self.vendor_notice | self.tool_notice
        kinds = lambda s, limit: F.array(
            F.when(self.vendor_path | self.tool_path, "path"), F.when(self.vendor_name | self.tool_name | self.packed_name, "name"),
            F.when(notice | self.packed_text(s, limit), "notice"), F.when(_layout_verdict(s, limit).isNotNull(), "layout"),
        )
        return F.when(self.language.isNotNull(), let(layout, lambda s: let(_limits(self.language), lambda limit: F.array_compact(kinds(s, limit)))))


def with_origin(df: DataFrame, path: str = "relative_path", name: str = "name", ext: str = "ext", content: str = "content", evidence: bool = False) -> DataFrame:
    """``df`` with ``language`` and ``origin`` of each file, and ``evidence`` if asked for; columns of these names are replaced.

    ``origin`` is null for files that are no source (language null as well),
    'handwritten', or one of 'vendored', 'generated', 'minified' and 'data':
    the first that path and name tell, then notices, then the layout.
    ``evidence`` lists which of 'path', 'name', 'notice' and 'layout' speak
    against hand-written source.  A null path, name or text simply gives no
    evidence; the shorter a text, the less its layout counts, and an empty one
    has none; line ends may be CRLF.  Rows are judged one by one: nothing is
    dropped, repeated rows get the same verdict, an empty table stays empty.
    """
    signs = _Signs(path, name, ext, content)
    layout = _statistics(F.col(content), False)
    more = {"evidence": signs.evidence(layout)} if evidence else {}
    return df.withColumns({"language": signs.language, "origin": signs.origin(layout), **more})


def source_origin(df: DataFrame, path: str = "relative_path", name: str = "name", ext: str = "ext", content: str = "content") -> DataFrame:
    """``with_origin`` and its evidence together with the layout statistics, which are made once."""
    signs = _Signs(path, name, ext, content)
    out = df.withColumn("_layout", _statistics(F.col(content)))
    out = out.withColumns({"language": signs.language, "origin": signs.origin(F.col("_layout")), "evidence": signs.evidence(F.col("_layout"))})
    statistics = out.schema["_layout"].dataType.names
    return out.withColumns({n: F.col("_layout")[n] for n in statistics}).drop("_layout")


def handwritten_source(df: DataFrame, path: str = "relative_path", name: str = "name", ext: str = "ext", content: str = "content") -> DataFrame:
    """The rows of ``df`` that are hand-written source, with their own columns only, whatever these are called."""
    names = {"_path": path, "_name": name, "_ext": ext, "_content": content}
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), *(F.col(c).alias(k) for k, c in names.items()))
    return with_origin(rows, *names).filter("origin = 'handwritten'").select("_row.*")
