"""The data model: notes own an ordered list of pages, pages own regions and labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The version of documents that readers accept.
CURRENT_VERSION = 6

RECT = "struct<x:int,y:int,w:int,h:int>"
NAME = "struct<name:string,edited:boolean>"
TITLE = f"struct<rect:{RECT},level:int,analysis:{NAME}>"
KEYWORD = "struct<text:string>"
LINK = f"struct<rect:{RECT},kind:string,target_page_id:string,target_file_id:string,target:string,target_doc_page:int,name:string,analysis:{NAME}>"
ANALYSIS = "struct<source_hash:string,fields:map<string,string>,regions:array<struct<id:string,source_hash:string>>>"
SECTION = "struct<id:string,label:string,text:string>"
BOX = f"struct<box_pos:int,box_id:string,label:string,rect:{RECT},analyze:boolean,prompt:string>"

NOTES = "file_id string, signature string, device string, source string, tags array<string>, schema_version int"
PLACEMENT = "file_id string, pos int, page_id string, number int"
PAGES = (
    "file_id string, page_id string, starred boolean, background_hash string, modified_at timestamp, device_modified_at timestamp, "
    f"device_hash string, tags array<string>, titles array<{TITLE}>, keywords array<{KEYWORD}>, links array<{LINK}>, analysis {ANALYSIS}, schema_version int"
)
TRANSCRIPTIONS = "file_id string, page_id string, md string, base string"
VECTORS = "file_id string, page_id string, svg string"
BOXES = f"background_hash string, box_pos int, box_id string, label string, rect {RECT}, analyze boolean, prompt string"
PARKED = f"{PAGES}, md string, base string"

#: Name under which the parked store appears among the holders of a page.
PARKED_HOLDER = "orphans"


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


@dataclass(frozen=True)
class Archive:
    """The tables of an archive. ``md`` is transcriptions with their machine-made base; ``boxes`` the template boxes."""

    notes: DataFrame
    placement: DataFrame
    pages: DataFrame
    md: DataFrame | None = None
    boxes: DataFrame | None = None
