"""speechstats.plans"""
