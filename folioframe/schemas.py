"""Fixed schemas of the layout tables. One document is a key (doc_id), not a process."""

from pyspark.sql.types import StructType

_BOX = "x0 double, y0 double, x1 double, y1 double"

DOC = StructType.fromDDL(
    "doc_id bigint, name string, title string, author string, subject string, keywords string, "
    "tagged boolean, lang string, perm_bits int, bytes bigint")
PAGE = StructType.fromDDL("doc_id bigint, page int, width double, height double, rotation int, bytes bigint")
TOC = StructType.fromDDL("doc_id bigint, seq int, level int, title string, page int")
SPAN = StructType.fromDDL(
    "doc_id bigint, page int, block int, line int, span int, text string, font string, size double, "
    f"flags int, color int, {_BOX}, dir_x double, dir_y double, link string")
CHAR = StructType.fromDDL(f"doc_id bigint, page int, block int, line int, seq int, c string, {_BOX}")
DRAWING = StructType.fromDDL(f"doc_id bigint, page int, seq int, kind string, fill array<double>, {_BOX}")
IMAGE = StructType.fromDDL(
    f"doc_id bigint, page int, seq int, xref int, smask int, w_px int, h_px int, ext string, alt string, {_BOX}")
LINK = StructType.fromDDL(f"doc_id bigint, page int, seq int, uri string, {_BOX}")
CELLBOX = StructType.fromDDL(f"doc_id bigint, page int, tbl int, seq int, {_BOX}")
MEASURE = "struct<kind:string,value:double,unit:string,label:string>"
STYLE = "struct<stroke:string,fill:string,opacity:double,width:double>"
FLAGS = "struct<locked:boolean,readOnly:boolean,print:boolean,hidden:boolean>"
ANNOT = StructType.fromDDL(
    "doc_id bigint, id string, page int, type string, rect array<double>, quads array<array<double>>, "
    "points array<array<double>>, strokes array<struct<pts:array<array<double>>,pressure:array<double>>>, "
    "callout array<array<double>>, text string, contents string, author string, subject string, "
    f"created timestamp_ntz, state string, checked boolean, tool string, measure {MEASURE}, "
    f"style {STYLE}, flags {FLAGS}")
RESPONSE = StructType.fromDDL(
    "doc_id bigint, id string, in_reply_to string, page int, author string, contents string, "
    "created timestamp_ntz, state string, seq bigint")
FIELD = StructType.fromDDL(
    "doc_id bigint, page int, seq int, name string, type string, value string, options array<string>, "
    f"required boolean, read_only boolean, {_BOX}")
TILE = StructType.fromDDL("doc_id bigint, version string, page int, cx int, cy int, tones array<int>")
SHEET_CELL = StructType.fromDDL("book string, sheet string, row int, col int, kind string, value string")
SHEET_MERGE = StructType.fromDDL("book string, sheet string, r0 int, c0 int, r1 int, c1 int")
SHEET_RULE = StructType.fromDDL(
    "book string, sheet string, rule int, kind string, op string, operand string, r0 int, c0 int, r1 int, c1 int")
PARA = StructType.fromDDL(
    "doc_id bigint, seq bigint, list_id bigint, num_id bigint, lvl int, fmt string, template string, start int, "
    "override_start int")
EDIT_EVENT = StructType.fromDDL(
    "doc_id bigint, seq bigint, ts timestamp, op string, annot_id string, merge_token string, before string, "
    "after string")
