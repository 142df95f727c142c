"""Document-corpus processing on PySpark: page routing, recognised text, lexicons, spelling, jobs, exports, images."""
