"""engram: a Spark-first engine for conversational-memory analytics.

Sub-packages
------------
sources     scans, chat-export readers, table description
functions   column helpers (text, vectors, decisions) and Arrow functions
operators   retrieval legs, fusion, graph, lifecycle, evaluation operators
plans       the registered queries and their oracle SQL
streaming   Structured Streaming forms of the interval and session jobs
llm         training-data operators (optional; nothing else imports it)
"""
