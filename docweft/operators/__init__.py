"""docweft.operators"""
