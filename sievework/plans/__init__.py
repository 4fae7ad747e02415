"""sievework.plans"""
