"""Schemas of the tables: pages with their words, hits, findings, inputs, persons."""

from __future__ import annotations

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
WORD = "struct<text:string,line:int,x0:double,y0:double,x1:double,y1:double>"
SEGMENT = "struct<word:int,c0:int,c1:int>"
PHRASE = "struct<tokens:array<string>,label:string,category:string,priority:int,fuzzy:boolean,possessive:boolean,capital:boolean,initials:array<string>,question:string>"

PAGES = f"case_id string, doc_id long, doc_seq int, page_no int, width double, height double, source string, words array<{WORD}>, unread array<{RECT}>"
HIT = f"segments array<{SEGMENT}>, text string, label string, category string, priority int, rects array<{RECT}>, enabled boolean, question string"
HITS = f"case_id string, doc_id long, doc_seq int, page_no int, seq int, {HIT}"
FINDINGS = "case_id string, doc_id long, page_no int, seq int, text string, kategorie string, bezug string, unsicher boolean, hinweis string"
INPUTS = "case_id string, mandant_name string, mandant_adresse string, gegner_name string, gegner_adresse string, custom array<struct<term:string,label:string>>, gegner_organisation boolean"
PERSONS = "case_id string, person_seq int, label string, kind string, names array<string>, tokens array<string>, fixed boolean"
