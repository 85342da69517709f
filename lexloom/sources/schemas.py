"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

QA_CORPUS = (
    "version string, data array<struct<title:string,enwiki_page_id:int,enwiki_title:string,plwiki_page_id:int,plwiki_title:string,paragraphs:array<struct<context:string,"
    "qas:array<struct<id:string,question:string,answers:array<struct<text:string,answer_start:int>>,is_impossible:boolean>>>>>>"
)
PREDICTIONS = "map<string,string>"
WIKI_PAGE = "title string, ns string, id bigint, revision struct<text:struct<_VALUE:string>>"
DOCUMENT = "struct<text:string,sentence:array<struct<token:array<struct<word:string,pos:string,originalText:string,ner:string,lemma:string>>>>>"
ARTICLE = f"title string, paragraphs array<struct<context:{DOCUMENT},qas:array<struct<id:string,question:{DOCUMENT},answers:array<{DOCUMENT}>,answerOffsets:array<int>>>>>"
