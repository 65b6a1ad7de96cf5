"""Schemas of tokens and of the lexicon's tables."""

TOKEN = "struct<surface:string,start:bigint,end:bigint,pos:string,base_form:string,reading:string,pronunciation:string,word_cost:smallint,is_known:boolean>"
TOKENS = f"array<{TOKEN}>"
LEXICON = "entry_id int, surface string, left_id int, right_id int, cost smallint, pos string, base_form string, reading string, pronunciation string"
MATRIX = "right_id int, left_id int, cost smallint"
CHAR_CLASS = "name string, invoke boolean, `group` boolean, length int"
CHAR_RANGE = "ord int, start int, `end` int, class string"
UNK = "class string, ord int, left_id int, right_id int, cost smallint, pos string"
META = "format string, version int, left_size int, right_size int, entries bigint, strings bigint, features bigint"
FORMAT, VERSION = "tsubame-lexicon", 1
