"""Files as tables: a row for each file, container and content operator.

read_files() scans a folder. nodes() turns files into rows once, in the tasks, a file at a time; all rules are columns
over these rows. Entries of a container are a map from its key or index to kind, text, number and length; keys that
begin with ~ are facts about what the entry leads to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscan.functions import fonts, xmp
from folioscan.sources.content_usage import Usage, content_usage, page_dicts
from folioscan.sources.pdf_bytes import Dict, Document, Hex, Name, ParseError, Ref, text_string, tokenize_content

ENTRY = "struct<k:string,s:string,n:double,len:int,ref:boolean>"
NODES = f"file_id bigint, node_id int, obj_num int, page int, kind string, roles array<string>, op string, seq int, entries map<string,{ENTRY}>, faults array<struct<rule:string,page:int>>, coverage array<string>"
_ENTRY = pa.struct([("k", pa.string()), ("s", pa.string()), ("n", pa.float64()), ("len", pa.int32()), ("ref", pa.bool_())])
_ARROW = pa.schema([("file_id", pa.int64()), ("node_id", pa.int32()), ("obj_num", pa.int32()), ("page", pa.int32()), ("kind", pa.string()), ("roles", pa.list_(pa.string())), ("op", pa.string()), ("seq", pa.int32()), ("entries", pa.map_(pa.string(), _ENTRY)), ("faults", pa.list_(pa.struct([("rule", pa.string()), ("page", pa.int32())]))), ("coverage", pa.list_(pa.string()))])
DEFAULT_SPACES = {"gray": "DefaultGray", "rgb": "DefaultRGB", "cmyk": "DefaultCMYK"}
#: Open saves of the graphics state at most.
MAX_NESTING = 28
#: Tasks for each core that files are spread over where their scan has fewer, so that no core waits for the others.
TASKS_A_CORE = 3
#: Rows that go to the JVM at once, about, and bytes of what a task makes from them.
ROWS_A_BATCH, HELD_BYTES = 5_000, 2 << 20
#: The role that a child gets from its key.
ROLES = {"Root": "catalog", "Info": "info", "A": "action", "OpenAction": "action", "AcroForm": "acroform", "ViewerPreferences": "viewer", "Metadata": "metadata", "AP": "appearance", "FontDescriptor": "descriptor", "Group": "group"}
CHILD_ROLES = {"Annots": "annot", "ExtGState": "gs", "Font": "font", "XObject": "xobject", "DescendantFonts": "cidfont", "OutputIntents": "intent", "Fields": "field", "Pattern": "pattern", "Shading": "shading"}
INFO_KEYS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate", "Trapped")


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf", stream: bool = False) -> DataFrame:
    """file_id (a hash of the path), path, content of the files below a folder; as a stream on demand."""
    kinds = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.schema(kinds) if stream else spark.read
    df = reader.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return df.select(F.xxhash64("path").alias("file_id"), "path", "content")


class Fact(NamedTuple):
    """Kind, text, number and length of a value, and whether it is a reference."""

    k: str = "null"
    s: str | None = None
    n: float | None = None
    len: int | None = None
    ref: bool = False


def entry(v: object, indirect: bool = False) -> Fact:
    kind = type(v)
    if kind is Name:
        return Fact("name", str(v), None, len(v), indirect)
    if kind is int:
        return Fact("int", str(v), float(v), None, indirect)
    if kind is Dict:
        return Fact("dict" if v.raw is None else "stream", None, None, len(v), indirect)
    if kind is list:
        return Fact("array", " ".join(x for x in v if type(x) is Name), None, len(v), indirect)
    if kind is float:
        return Fact("real", None, v, None, indirect)
    if kind is bool:
        return Fact("bool", str(v).lower(), None, None, indirect)
    if kind is Hex:
        return Fact("hex", v.decode("latin-1"), None, len(v.value), indirect)
    if isinstance(v, bytes):
        return Fact("str", text_string(v), None, len(v), indirect)
    return Fact(ref=indirect)


def icc_fault(data: bytes) -> bool:
    return len(data) < 128 or data[36:40] != b"acsp" or data[8] >= 3 or data[12:16] not in (b"scnr", b"mntr", b"prtr", b"spac") or data[16:20] not in (b"RGB ", b"CMYK", b"GRAY", b"Lab ")


def cmap_subtables(program: bytes) -> int | None:
    """The number of subtables of a font program's character map; None without a map."""
    for k in range(int.from_bytes(program[4:6], "big")):
        entry = program[12 + 16 * k : 28 + 16 * k]
        if entry[:4] == b"cmap":
            at = int.from_bytes(entry[8:12], "big")
            return int.from_bytes(program[at + 2 : at + 4], "big") if at + 4 <= len(program) else None
    return None


def largest_cid(cmap: str) -> int:
    """The largest third number of a range or second of a single in a character map's blocks."""
    out = 0
    for kind, body in re.findall(r"begincid(range|char)(.*?)endcid", cmap, re.S):
        tokens = re.findall(r"<[^>]*>|[^\s<]+", body)
        step = 3 if kind == "range" else 2
        out = max([out, *(int(t) for t in tokens[step - 1 :: step] if t.isdigit())])
    return out


class Walk:
    """All rows of one file."""

    def __init__(self, file_id: int, data: bytes, model=None):
        self.model = model
        self.file_id, self.doc, self.rows, self.page, self.pages = file_id, Document(data).open(), [], 0, 0
        self.coverage: list[str] = []
        self.seen: set[int] = set()
        self.deep: list[int] = []  # the pages of saves that nest too deep
        self.tokens: dict[int, list] = {}
        self.defaults: list[str] = []  # the models that the page's resources replace
        self.used: Usage | None = None

    def row(self, kind: str, **x) -> dict:
        r = {"file_id": self.file_id, "node_id": len(self.rows), "obj_num": None, "page": self.page, "kind": kind, "roles": [], "op": None, "seq": None, "entries": [], "faults": [], "coverage": self.coverage} | x
        if r["obj_num"] is not None and r["obj_num"] >= 1 << 31:
            r["obj_num"] = None  # beyond what a file may number
        self.rows.append(r)
        return r

    def run(self) -> list[dict]:
        d = self.doc
        if d.error:
            self.row("file", entries=self.header(), faults=[{"rule": "GraphResolutionFailure", "page": 0}])
            return self.rows
        self.cover()
        self.used = content_usage(d, self.ops)
        try:
            trailer = Dict(d.trailer)
            self.visit(trailer, ["trailer"], 0, None, "FileTrailer" if self.model else "")
        except RecursionError:
            d.faults.append(("GraphResolutionFailure", 0))
        for num in list(d.xref):
            d.resolve(Ref(num, 0))
        faults = [{"rule": r, "page": 0} for r, _ in dict.fromkeys(d.faults)] + [{"rule": "GraphicsStateNesting", "page": p} for p in self.deep]
        self.page = 0
        self.row("file", entries=self.header(), faults=faults + self.metadata())
        return self.rows

    def header(self) -> list[tuple[str, dict]]:
        d = self.doc.data
        lines = re.split(rb"\r\n|\r|\n", d[:128])
        second = lines[1] if len(lines) > 1 else b""
        facts = {"~line1": entry(bytes(lines[0])), "~line2": Fact("str", second[:5].hex(), None, len(second)), "~eof": entry(b"%%EOF" in d[-9:]), "~objects": entry(len(self.doc.xref)), "~pages": entry(self.pages)}
        if isinstance(n := self.doc.path("Root", "Pages", "Count"), int):
            facts["~count"] = entry(n)
        return list(facts.items())

    def cover(self) -> None:
        d = self.doc
        intents = d.path("Root", "OutputIntents")
        for i in intents if isinstance(intents, list) else []:
            i = d.resolve(i)
            p = d.resolve(i.get("DestOutputProfile")) if isinstance(i, Dict) and i.get("S") == "GTS_PDFA1" else None
            if isinstance(p, Dict) and (n := d.resolve(p.get("N"))) in (1, 3, 4):
                self.coverage = {1: ["gray"], 3: ["gray", "rgb"], 4: ["gray", "cmyk"]}[n]

    def ops(self, s: Dict) -> list[tuple[str, list]]:
        """The operators of a stream, tokenized once."""
        if (found := self.tokens.get(id(s))) is None:
            try:
                found = tokenize_content(self.doc.decoded(s))
            except ValueError:
                found = []
            self.tokens[id(s)] = found
        return found

    def replaced(self, resources: object) -> list[str]:
        """The device models for which resources name a default space."""
        spaces = self.doc.resolve(resources.get("ColorSpace")) if isinstance(resources, Dict) else None
        return [m for m, k in DEFAULT_SPACES.items() if isinstance(spaces, Dict) and self.doc.resolve(spaces.get(k)) is not None]

    def visit(self, v: object, roles: list[str], depth: int, num: int | None, om_type: str = "") -> None:
        d = self.doc
        if not isinstance(v, (Dict, list)) or id(v) in self.seen or depth > 900:
            return
        self.seen.add(id(v))
        items = list(sorted(v.items()) if isinstance(v, Dict) else ((str(k), x) for k, x in enumerate(v)))
        if isinstance(v, Dict) and v.get("Type") == "Page":
            self.pages += 1
            self.page = self.pages
            roles = [*roles, "page"]
            self.defaults = self.replaced(d.resolve(v.get("Resources")))
        if om_type:
            roles = [*roles, "=" + om_type]
        if isinstance(v, Dict) and v.is_stream and v.get("Subtype") == "Form" and id(v) not in self.used.forms:
            roles = [*roles, "unreached"]
        found = [d.resolve(x) if type(x) is Ref else x for _, x in items]
        entries = [(k, entry(child, type(x) is Ref)) for (k, x), child in zip(items, found)]
        r = self.row("array" if isinstance(v, list) else "stream" if v.is_stream else "dict", obj_num=num, roles=roles)
        r["entries"] = entries + [(f"~{k}", entry(x)) for k, x in (self.facts(v, roles).items() if isinstance(v, Dict) else ())]
        if isinstance(v, Dict) and (v.get("Subtype") == "Image" or "shading" in roles) and self.defaults:
            r["coverage"] = [*self.coverage, *self.defaults]
        if isinstance(v, Dict) and ("font" in roles or "cidfont" in roles):
            r["faults"] = [{"rule": x, "page": self.page} for x in self.font_faults(v)]
        if isinstance(v, Dict) and v.is_stream:
            self.content(v, roles)
        for (k, x), child in zip(items, found):
            if not isinstance(child, (Dict, list)):
                continue
            if isinstance(v, Dict):
                own = [ROLES[k]] if k in ROLES else [f"each:{CHILD_ROLES[k]}"] if k in CHILD_ROLES else []
                if k == "Contents":
                    own = ["content"]
                elif k == "Kids" and {"field", "annot"} & set(roles):
                    own = ["each:field"]
                elif k == "CharProcs":
                    own = ["each:content"]
            else:
                own = ["content"] if "content" in roles else []
            own += [x[5:] for x in roles if x.startswith("each:")]
            below = self.model.child(om_type, k, "array" if isinstance(child, list) else "stream" if child.is_stream else "dict", child, d.resolve) if om_type else ""
            self.visit(child, own, depth + 1, x.num if isinstance(x, Ref) else None, below)

    def font_faults(self, v: Dict) -> list[str]:
        """What a font dictionary states against its program and its use."""
        d, get = self.doc, self.doc.resolve
        if v.get("Type") != "Font" or self.used.invisible_only(v):
            return []
        kind = get(v.get("Subtype"))
        if kind == "Type3":
            enc = get(v.get("Encoding"))
            first, last, widths = get(v.get("FirstChar")), get(v.get("LastChar")), get(v.get("Widths"))
            if not (type(first) is type(last) is int and isinstance(widths, list) and isinstance(enc, Dict) and isinstance(get(enc.get("Differences")), list)):
                return []
            widths = [fonts.number(get(w)) or 0.0 for w in widths]
            advances = fonts.type3_advances(get(v.get("CharProcs")), get, lambda s: self.ops(s) if s.is_stream else [])
            return ["AdvanceWidthMismatch"] * fonts.type3_fault(first, last, widths, dict(enumerate(fonts.glyph_table(enc, get))), advances)

        def body(x: object) -> bytes | None:
            try:
                return d.decoded(x) if isinstance(x, Dict) and x.is_stream else None
            except ValueError:
                return None

        used = self.used.cids.get(id(v)) if kind in ("CIDFontType0", "CIDFontType2") else self.used.codes.get(id(v))
        program = fonts.program_of(v, get, body, used)
        return fonts.font_faults(program) if program else []

    def facts(self, v: Dict, roles: list[str]) -> dict[str, object]:
        """What rules need to know of an entry's target."""
        d, out = self.doc, {}
        if "font" in roles or "cidfont" in roles:
            f = d.resolve(v.get("FontDescriptor"))
            f = f if isinstance(f, Dict) else {}
            out["Embedded"] = Name(next((k for k in ("FontFile", "FontFile2", "FontFile3") if isinstance(d.resolve(f.get(k)), Dict)), "none"))
            out["Flags"] = d.resolve(f.get("Flags")) or 0
            out |= {"Shown": id(v) in self.used.codes, "Invisible": self.used.invisible_only(v)}
            first, last = d.resolve(v.get("FirstChar")), d.resolve(v.get("LastChar"))
            if isinstance(first, int) and isinstance(last, int):
                out["Span"] = last - first + 1
            for k in ("FontFile", "FontFile2", "FontFile3"):
                if isinstance(p := d.resolve(f.get(k)), Dict):
                    try:
                        body = d.decoded(p)
                    except ValueError:
                        body = b""
                    good = {"FontFile": body[:2] == b"%!", "FontFile2": body[:4] in (b"\0\1\0\0", b"true", b"OTTO"), "FontFile3": body[:1] == b"\1" or body[:4] in (b"\0\1\0\0", b"OTTO")}
                    out["Program"] = good[k]
                    if k == "FontFile2" and good[k] and (n := cmap_subtables(body)) is not None:
                        out["Cmaps"] = n
            e = d.resolve(v.get("Encoding"))
            if isinstance(e, Dict) and isinstance(i := d.resolve(e.get("CIDSystemInfo")), Dict):
                kids = d.resolve(v.get("DescendantFonts"))
                c = d.resolve(kids[0]) if isinstance(kids, list) and kids else None
                j = d.resolve(c.get("CIDSystemInfo")) if isinstance(c, Dict) else None
                out["SameSystem"] = isinstance(j, Dict) and all(text_string(d.resolve(i.get(k))) == text_string(d.resolve(j.get(k))) for k in ("Registry", "Ordering"))
            if isinstance(e, Dict) and e.is_stream:
                try:
                    text = d.decoded(e).decode("latin-1")
                except ValueError:
                    text = ""
                out["CID"] = largest_cid(text)
                stated, own = re.search(r"/WMode\s+(\d+)", text), d.resolve(e.get("WMode"))
                out["WModes"] = not (stated and isinstance(own, int) and own != int(stated[1]))
        if "catalog" in roles and isinstance(i := d.resolve(v.get("OutputIntents")), list):
            i = [d.resolve(x) for x in i]
            profiles = [p for x in i if isinstance(x, Dict) and isinstance(p := d.resolve(x.get("DestOutputProfile")), Dict)]
            out |= {"IntentNotDict": any(not isinstance(x, Dict) for x in i), "IntentProfiles": any(p is not profiles[0] and (dict(p) != dict(profiles[0]) or p.raw != profiles[0].raw) for p in profiles)}
        if "intent" in roles:
            p = d.resolve(v.get("DestOutputProfile"))
            if isinstance(p, Dict):
                n = d.resolve(p.get("N"))
                out |= {"N": n if isinstance(n, int) else None}
                try:
                    out["BadICC"] = icc_fault(body := d.decoded(p))
                    out["Space"] = {b"RGB ": 3, b"CMYK": 4, b"GRAY": 1, b"Lab ": 3}.get(body[16:20])
                except ValueError:
                    out["BadICC"] = True
        if "annot" in roles or "field" in roles:
            at, hops = v, 0
            while isinstance(at, Dict) and "FT" not in at and hops < 20:
                at, hops = d.resolve(at.get("Parent")), hops + 1
            if isinstance(at, Dict) and "FT" in at:
                out["FT"] = d.resolve(at["FT"])
            ap = d.resolve(v.get("AP"))
            if isinstance(ap, Dict):
                n = d.resolve(ap.get("N"))
                out |= {"N": Name("stream" if isinstance(n, Dict) and n.is_stream else "dict" if isinstance(n, Dict) else "none" if n is None else "other"), "Extra": any(k != "N" for k in ap)}
            for k in ("C", "IC"):
                if isinstance(c := d.resolve(v.get(k)), list) and (m := {1: "gray", 3: "rgb", 4: "cmyk"}.get(len(c))):
                    out[f"Model{k}"] = Name(m)
        if isinstance(g := d.resolve(v.get("Group")), Dict):
            out["GroupS"] = d.resolve(g.get("S"))
        if "metadata" in roles:
            try:
                out["XPacket"] = b"<?xpacket" in d.decoded(v)
            except ValueError:
                out["XPacket"] = False
            out["Catalog"] = v is d.path("Root", "Metadata")
        cs = d.resolve(v.get("ColorSpace"))
        while isinstance(cs, list) and cs:
            head = d.resolve(cs[0])
            cs = d.resolve(cs[1]) if head in ("Indexed", "Pattern") and len(cs) > 1 else head
        if isinstance(cs, Name) and (m := {"DeviceRGB": "rgb", "DeviceCMYK": "cmyk", "DeviceGray": "gray", "RGB": "rgb", "CMYK": "cmyk", "G": "gray"}.get(cs)):
            out["Model"] = Name(m)
        return out

    def content(self, v: Dict, roles: list[str]) -> None:
        if "content" not in roles and not ("xobject" in roles and v.get("Subtype") == "Form") and "pattern" not in roles:
            return
        ops = self.ops(v)
        coverage = [*self.coverage, *self.defaults, *self.replaced(self.doc.resolve(v.get("Resources")))]
        unreached = ["unreached"] if "unreached" in roles else []
        at, depth = len(self.rows) - 1, 0
        for seq, (op, operands) in enumerate(ops):
            depth = depth + 1 if op == "q" else max(0, depth - 1) if op == "Q" else depth
            if op == "q" and depth > MAX_NESTING:
                self.deep.append(self.page)
            x = [(k, entry(y)) for k, y in operands[0].items()] if op == "BI" else [(str(k), entry(y)) for k, y in enumerate(operands)]
            self.row("op", obj_num=at, op=op, seq=seq, entries=x, coverage=coverage, roles=unreached)

    def metadata(self) -> list[dict]:
        d = self.doc
        m = d.path("Root", "Metadata")
        info = d.path("Info")
        raw = {k: d.resolve(info.get(k)) for k in INFO_KEYS if k in info} if isinstance(info, Dict) else {}
        texts = {k: t for k, x in raw.items() if (t := text_string(x)) is not None}
        out = []
        if d.trailer.get("Info") is not None and not isinstance(info, Dict):
            out.append("InfoDictUnreadable")
        out += ["InfoDictEmptyValues"] * any(not t for t in texts.values())
        if not isinstance(m, Dict) or not m.is_stream:
            out.append("MetadataMissing")
        else:
            if "Filter" in m:
                out.append("MetadataFiltered")
            try:
                out += xmp.packet_faults(xmp.decode_packet(d.decoded(m)), {k: t for k, t in texts.items() if t})
            except ValueError:
                out.append("XMPStreamUnreadable")
        return [{"rule": r, "page": 0} for r in out]


def record_batch(rows: list[dict]) -> pa.RecordBatch:
    """Rows of a Walk; the maps are built from flat columns."""
    at, flat = [0], []
    for r in rows:
        flat += r["entries"]
        at.append(len(flat))
    keys = pa.array([k for k, _ in flat], pa.string())
    columns = list(zip(*(f for _, f in flat))) or [()] * 5
    values = pa.StructArray.from_arrays([pa.array(c, _ENTRY[k].type) for k, c in enumerate(columns)], fields=list(_ENTRY))
    entries = pa.MapArray.from_arrays(pa.array(at, pa.int32()), keys, values)
    plain = [pa.array([r[f.name] for r in rows], f.type) if f.name != "entries" else entries for f in _ARROW]
    return pa.RecordBatch.from_arrays(plain, schema=_ARROW)


def _rows(batches: Iterator[pa.RecordBatch], model=None) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for b in batches:
        for file_id, content in zip(b.column(0).to_pylist(), b.column(1)):
            try:
                held += Walk(file_id, content.as_py() or b"", model).run()
            except (ParseError, ValueError, TypeError, AttributeError, KeyError, IndexError, RecursionError) as x:  # damaged beyond reading
                # anything but a ParseError may be a fault of a rule and not of the file: its kind and place are kept
                at = x.__traceback__
                while at.tb_next:
                    at = at.tb_next
                what = f"{type(x).__name__} {at.tb_frame.f_code.co_name}:{at.tb_lineno}"
                w = Walk(file_id, b"")
                held += [w.row("file", entries=[("~unread", Fact("str", what, None, len(what)))], faults=[{"rule": "GraphResolutionFailure", "page": 0}])]
            while len(held) >= ROWS_A_BATCH:
                yield record_batch(held[:ROWS_A_BATCH])
                held = held[ROWS_A_BATCH:]
    if held:
        yield record_batch(held)


def spread(files: DataFrame, key: str = "file_id") -> DataFrame:
    """The same rows in enough partitions for all cores. What has as many stays as it is, and so does a stream. A scan of
    few tables' files is shuffled however many partitions it has, as the rows of a row group are all in one of them."""
    if files.isStreaming:
        return files
    enough = TASKS_A_CORE * files.sparkSession.sparkContext.defaultParallelism
    n = files.rdd.getNumPartitions()
    if n >= enough:
        plan = files._jdf.queryExecution().sparkPlan().toString()
        if "FileScan" not in plan or "Exchange" in plan or len(files.inputFiles()) >= enough:
            return files
    return files.repartition(max(n, enough), F.xxhash64(key))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches by some HELD_BYTES of them, so that what a task makes of them is as small."""
    for b in batches:
        n = max(1, b.num_rows * HELD_BYTES // max(HELD_BYTES, b.nbytes))
        for k in range(0, b.num_rows, n):
            yield b.slice(k, n)


def nodes(files: DataFrame, model=None) -> DataFrame:
    """The rows of files (file_id, content). With a model (folioscan.plans.model_tsv) containers that its links reach from
    the trailer on have its types among their roles, behind an equals sign. A file that can't be opened has one row with the fault; where reading it
    broke off, its entry ~unread says how, which unread_files() lists."""
    return spread(files.select(F.col("file_id").cast("bigint").alias("file_id"), "content")).mapInArrow(lambda batches: _rows(batches, model), StructType.fromDDL(NODES))


def unread_files(rows: DataFrame) -> DataFrame:
    """file_id, reason of the files of nodes() whose reading broke off."""
    return rows.where(F.map_contains_key("entries", F.lit("~unread"))).select("file_id", F.col("entries")["~unread"].s.alias("reason"))


META = "file_id bigint, version string, pages int, declared_pages int, part string, conformance string, info map<string,string>, xmp string"


def page_count(d: Document) -> int:
    """The pages that are reachable in the page tree, each once."""
    return sum(1 for _ in page_dicts(d))


def files_meta(files: DataFrame) -> DataFrame:
    """Version, page counts, claimed conformance, information entries and metadata packet of each file."""
    kinds = pa.schema([("file_id", pa.int64()), ("version", pa.string()), ("pages", pa.int32()), ("declared_pages", pa.int32()), ("part", pa.string()), ("conformance", pa.string()), ("info", pa.map_(pa.string(), pa.string())), ("xmp", pa.string())])

    def one(file_id: int | None, content: bytes) -> dict:
        r = {"file_id": file_id, "version": (m[1].decode() if (m := re.match(rb"%PDF-(\d\.\d)", content)) else None), "pages": 0, "declared_pages": 0, "info": []}
        d = Document(content).open()
        if d.error:
            return r
        try:
            n, info, m = d.path("Root", "Pages", "Count"), d.path("Info"), d.path("Root", "Metadata")
            try:
                text = xmp.decode_packet(d.decoded(m)) if isinstance(m, Dict) and m.is_stream else None
            except ValueError:
                text = None
            part, level = xmp.claimed(text or "")
            return r | {"pages": page_count(d), "declared_pages": n if isinstance(n, int) and abs(n) < 1 << 31 else 0, "part": part, "conformance": level, "xmp": text, "info": [(k, t) for k, x in sorted(info.items()) if (t := text_string(d.resolve(x))) is not None] if isinstance(info, Dict) else []}
        except (ParseError, ValueError, TypeError, AttributeError, KeyError, IndexError, RecursionError):
            return r

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_pylist([one(k, c.as_py() or b"") for k, c in zip(b.column(0).to_pylist(), b.column(1))], kinds)

    return spread(files.select(F.col("file_id").cast("bigint").alias("file_id"), "content")).mapInArrow(read, META)


def content_texts(files: DataFrame) -> DataFrame:
    """file_id, pages and text: what the marked content of the pages states as its actual text, in order."""

    def one(content: bytes) -> tuple[int, str]:
        d = Document(content).open()
        n, parts = 0, []
        for page, _ in page_dicts(d) if not d.error else ():
            n += 1
            c = d.resolve(page.get("Contents"))
            for s in [c] if isinstance(c, Dict) else c if isinstance(c, list) else []:
                s = d.resolve(s)
                if not isinstance(s, Dict) or not s.is_stream:
                    continue
                try:
                    ops = tokenize_content(d.decoded(s))
                except ValueError:
                    continue
                for op, operands in ops:
                    t = operands[1].get("ActualText") if op == "BDC" and len(operands) > 1 and isinstance(operands[1], Dict) else None
                    if isinstance(t, bytes):
                        parts.append(t.value if isinstance(t, Hex) else bytes(t))
        return n, b"".join(parts).decode("utf-8", "replace")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [one(c.as_py() or b"") for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int32()), pa.array([t for _, t in found], pa.string())], ["file_id", "pages", "text"])

    return spread(files.select(F.col("file_id").cast("bigint").alias("file_id"), "content")).mapInArrow(read, "file_id bigint, pages int, text string")
