"""sievework.streaming"""
