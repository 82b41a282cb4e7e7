from pagelake.functions import hashing, http, jsonpath, redaction, text, urls

__all__ = ["hashing", "http", "jsonpath", "redaction", "text", "urls"]
