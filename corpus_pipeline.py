"""The corpus pipeline: stages over the documents table, each by an operator of quorumlake.llm."""

from quorumlake.llm import pipeline

STAGES = pipeline.STAGES
run = pipeline.run
#: None: tokenisation, suffix sorting and rounding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
