"""speechstats.functions"""
