"""Declared schemas; nothing is inferred from files."""

from pyspark.sql import types as T

S, I, D = T.StringType(), T.IntegerType(), T.DoubleType()
TEXTS = T.ArrayType(S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in fields.items()])


ELEMENT = _struct(section=S, pos=I, is_label=T.BooleanType(), label=S, text=S)
PAGE_PARTS = _struct(participants=TEXTS, has_prepared=T.BooleanType(), has_qa=T.BooleanType(), elements=T.ArrayType(ELEMENT), error=S)
TURN = _struct(speaker_raw=S, speaker_name=S, speaker_title=S, role=S, text=S, sentences=TEXTS, section=S)
TRANSCRIPT = _struct(
    ticker=S, date=S, quarter=S, source=S, source_url=S, word_count=I, sentence_count=I, prepared_remarks=TEXTS, qa_ceo=TEXTS, qa_analyst=TEXTS,
    guidance_sentences=TEXTS, speaker_turns=T.ArrayType(TURN), call_participants=TEXTS, parse_errors=TEXTS,
)
PAGE_META = _struct(ticker=S, date=S, source=S, url=S, word_count=I)
SENTENCE_SCORE = _struct(positive=D, negative=D, neutral=D)
PRICES = _struct(ticker=S, date=T.DateType(), close=D)
FILINGS = _struct(
    cik=S, filings=_struct(recent=_struct(form=TEXTS, filingDate=TEXTS, accessionNumber=TEXTS, primaryDocument=TEXTS)),
)
