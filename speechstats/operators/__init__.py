"""speechstats.operators"""
