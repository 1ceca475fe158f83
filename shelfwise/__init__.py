"""Product-catalogue analytics as PySpark DataFrame jobs.

Sub-packages: ``sources`` (reading, landing, generating), ``functions`` (column
expressions), ``operators`` (table-to-table steps), ``plans`` (whole reports and
batch jobs) and ``streaming``.
"""
