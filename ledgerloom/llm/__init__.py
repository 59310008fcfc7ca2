"""Training-data operators.

Nothing outside this subpackage imports it; it may import the rest of the
library.  Every operator works on whole tables and whole texts, keeps its
intermediate tables in the shared checkpoint folder and never collects
per-document data to the driver.
"""
