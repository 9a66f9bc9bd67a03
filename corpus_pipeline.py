"""The corpus pipeline: stages over documents, each one written as Parquet and read again as the next one's input.

Quality classifier (rejected documents go), line dedup (repeated lines go), n-gram Jaccard join (one document of each
group stays), mixing to target weights (documents are left out or repeated), BPE codes.  All stages but the last
return the columns of documents.

Defined cases: a null text counts as empty; without labels every document scores 0.5 and stays; documents without words
stay until the mix, which takes none of their words; a null source is a source of its own; a null doc_id is no
near-duplicate and is mixed like others; repeated rows are near-duplicates of each other only if their doc_ids differ, and rows that share
a doc_id stay or go together; an empty table gives no rows; extra columns pass through to the last stage, which returns doc_id, lang and source
beside the codes.
"""

from lorequarry.llm import bpe, jaccard, lines, mixing, quality
from lorequarry.llm.durable import durable
from lorequarry.llm.queries import tokenizer_path


def good(spark, docs, sf_dir):
    """Documents that the classifier, fitted on the labels of the folder, does not reject."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unrepeated(spark, docs, sf_dir):
    """Lines of 40 characters or more that stand in five documents stay in the largest doc_id only; a document may become empty."""
    return lines.without_repeated_lines(docs)


def distinct(spark, docs, sf_dir):
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return jaccard.one_of_each_group(docs, k=5, num=80, den=100)


def mixed(spark, docs, sf_dir):
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encoded(spark, docs, sf_dir):
    """Ids and decoded text of each document."""
    return bpe.bpe_codes(docs, tokenizer_path(), [c for c in ("doc_id", "lang", "source") if c in docs.columns])


STAGES = [("quality", good), ("lines", unrepeated), ("near_duplicates", distinct), ("mixing", mixed), ("bpe", encoded)]
ORACLE_SQL = None  # the classifier and the codes are beyond SQL; tests hold the stages against plain Python


def run(spark, sf_dir):
    """All stages over the documents of the folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, name)
    return docs
