"""Registered queries, one for each operator, and the SQL that they are compared with."""

from pactum.catalog._base import ORACLES, QUERIES
from pactum.catalog import contract_checks, joins, result_modes, scalars, scans, shapes, streams, tables, texts

