"""docweft.plans"""
