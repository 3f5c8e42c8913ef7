"""No streaming operators.

The reference only detects streaming tables and leaves them out of scope; it
has no watermark, window or stateful operator, so nothing is built here.
"""
