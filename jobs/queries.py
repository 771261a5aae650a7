"""The jobs as queries, with the SQL that says the same."""

from jobs import growth, tiles

QUERIES = {"job1_tiles": (tiles.job1_tiles, tiles.JOB1_SQL), "job2_growth": (growth.job2_growth, growth.JOB2_SQL)}
