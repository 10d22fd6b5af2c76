"""Explicit schemas of the engine's tables."""

from __future__ import annotations

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENS = "sent_id long, pos int, surface string, token string, tag string, is_punc boolean"
SENTENCES = "sent_id long, surfaces array<string>, tokens array<string>, tags array<string>"
DEPENDENCY = "struct<idx:int,head:int,type:string>"
PATTERNS = "gram string, n int, freq long, prob double, quality double, label int, indicator string"
OCCURRENCES = "gram string, n int, sent_id long, st int, ed int"
SEGMENT = "struct<st:int,ed:int,indicator:string>"
MENTION = "struct<start:int,end:int,text:string>"
SENTENCE_JSON = "tokens array<string>, pos array<string>, entityMentions array<array<string>>, ner array<string>, sentText string"
CORENLP_JSON = "sentences array<struct<index:int,tokens:array<struct<word:string,lemma:string,pos:string,ner:string>>>>"
GOLD_JSON = "articleId string, sentences array<struct<sentId:int,sentText:string,relationMentions:array<struct<em1Text:string,em2Text:string,label:string>>>>"
SEEDS = "doc long, surface string, begin string, uri string, sim double, second_rank double"
EMBEDDING = "key string, vec array<double>"
TREE_STATS = "shape string, total long, chosen long, prob double"
TUPLE = "sent_id long, subj string, rels array<string>, obj string"
PATH = "sent_id long, obj int, subj int, path array<int>"
